"""Queries over the operators of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import grouped_split, packing, toxicity
from sightline.llm.grouped_split import RelatedImages
from sightline.llm.mixing import SourceMix
from sightline.llm.permanent import stable_samples
from sightline.llm.proportions import ProportionalSample
from sightline.llm.tokens import with_tokens
from sightline.llm.toxicity import ToxicityModel
from sightline.llm.truncation import TruncationModel, message_texts
from sightline.storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _proportional(spark: SparkSession, d: str) -> ProportionalSample:
    return ProportionalSample(_table(spark, d, "instructions"), _table(spark, d, "train_runs"), _table(spark, d, "selection_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the sample leaves with a gap because their supply is below their need."""
    return _proportional(spark, d).report().filter("unmeetable").select("target_id")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled records of each run."""
    return _proportional(spark, d).sample.select("run_id", "instruction_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Need, supply, sampled count and gap of each target."""
    return _proportional(spark, d).report()


def p2_samples(spark: SparkSession, d: str) -> DataFrame:
    """The records selected for each run at each snapshot."""
    return stable_samples(_table(spark, d, "instructions"), _table(spark, d, "train_runs"), _table(spark, d, "pool_snapshots"))


def p2_kept_store(spark: SparkSession, d: str) -> DataFrame:
    """The same from a store that an earlier call, which knew the first two snapshots only, has filled."""
    instructions, runs, snapshots = (_table(spark, d, n) for n in ("instructions", "train_runs", "pool_snapshots"))
    path = scratch_path(spark, "p2-kept")
    stable_samples(instructions, runs, snapshots.orderBy("until_at", "snapshot_no").limit(2), path)
    return stable_samples(instructions, runs, snapshots, path)


def _truncation(spark: SparkSession, d: str) -> TruncationModel:
    return TruncationModel(message_texts(_table(spark, d, "instructions"), _table(spark, d, "predictions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Instructions and predictions with a cut text."""
    return _truncation(spark, d).cut_rows()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut rows per source of instructions and run of predictions."""
    return _truncation(spark, d).rates()


def _related(spark: SparkSession, d: str) -> RelatedImages:
    return RelatedImages(_table(spark, d, "images"), _table(spark, d, "instructions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Images of related groups whose records carry several splits today."""
    return _related(spark, d).scattered()


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """One split for each group of related images."""
    return _related(spark, d).assign()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Records per split and stratum under the new splits."""
    return grouped_split.split_report(_related(spark, d).assign())


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(with_tokens(_table(spark, d, "documents"), ["doc_id"]), _table(spark, d, "pack_containers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split, per capacity."""
    return packing.split_documents(_packed(spark, d))


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    """What each container holds."""
    return _packed(spark, d)


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and how full they are, per capacity."""
    return packing.fill_report(_packed(spark, d))


def _mix(spark: SparkSession, d: str) -> SourceMix:
    return SourceMix(with_tokens(_table(spark, d, "documents"), ["doc_id", "source"]), _table(spark, d, "mix_plan"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Plan rows whose source falls short with all its repeats taken."""
    return _mix(spark, d).report().filter("short").select("plan_id", "source")


def p6_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Each plan's documents in training order."""
    return _mix(spark, d).sequence()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, possible and taken tokens and the actual share of each plan row."""
    return _mix(spark, d).report()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents = _table(spark, d, "documents")
    return ToxicityModel(documents, _table(spark, d, "content_labels")).scores(documents)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual wording."""
    return _scores(spark, d).filter("toxic").select("doc_id").distinct()


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, d)


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of toxic documents per source."""
    return toxicity.rates(_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_sample, p1_report, p2_samples, p2_kept_store, p3_found, p3_rates, p4_found, p4_splits, p4_report, p5_found, p5_containers, p5_fill, p6_found, p6_sequence, p6_report, p7_found, p7_scores, p7_rates,
    )
}
