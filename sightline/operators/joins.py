"""Key lookups between records, predictions, images and logs. Spark chooses broadcast or sort-merge by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.storage import cut_lineage


def coverage(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side) with side missing (no prediction) or extra (no truth)."""
    t, p = truth.select(key).distinct().withColumn("t", F.lit(1)), predictions.select(key).distinct().withColumn("p", F.lit(1))
    return t.join(p, key, "full_outer").filter("t IS NULL OR p IS NULL").select(key, F.when(F.col("p").isNull(), "missing").otherwise("extra").alias("side"))


def require_empty(df: DataFrame, message: str) -> None:
    """Raises if there is any row."""
    first = df.limit(5).collect()
    if first:
        raise ValueError(f"{message}: {[r[0] for r in first]}")


def pending(work: DataFrame, completed: DataFrame, key: str, failed: DataFrame | None = None, retry: bool = False) -> DataFrame:
    """Work without what is completed, and without what failed unless it is to be retried."""
    left = work.join(completed.select(key), key, "left_anti")
    return left if failed is None or retry else left.join(failed.select(key), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def finalize(work: DataFrame, results: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Results in the order of the work; raises unless both hold the same keys."""
    require_empty(coverage(work, results, key), "work and results differ")
    return work.select(key, ordinal).join(results, key).orderBy(ordinal)


def finalize_runs(work: DataFrame, results: DataFrame, run: str, key: str, ordinal: str) -> DataFrame:
    """Results of all runs in the order of their work, with ``side`` (both, missing or extra) and ``complete``: whether the run's key sets are equal.

    Where ``finalize`` raises, the keys that differ are rows here, and a run without any is final.
    """
    both = work.select(run, key, ordinal, F.lit(1).alias("__w")).join(results.withColumn("__r", F.lit(1)), [run, key], "full_outer")
    side = F.when(F.col("__r").isNull(), "missing").when(F.col("__w").isNull(), "extra").otherwise("both")
    both = cut_lineage(both.withColumn("side", side).drop("__w", "__r"), "finalized")
    runs = both.groupBy(run).agg(F.bool_and(F.col("side") == "both").alias("complete"))
    return both.join(runs, run).orderBy(run, F.asc_nulls_last(ordinal), key)


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images (path, mask_path wanted, category, stem) with the mask at the wanted path, else the smallest one with the same category and stem."""
    exact = masks.select(F.col("path").alias("wanted"), F.col("path").alias("exact"))
    same = masks.groupBy("category", "stem").agg(F.min("path").alias("fallback"))
    return images.join(exact, "wanted", "left").join(same, ["category", "stem"], "left").withColumn("mask", F.coalesce("exact", "fallback")).drop("exact", "fallback")


def template_cross(images: DataFrame, templates: DataFrame, per_normal: int, per_anomalous: int) -> DataFrame:
    """Each image with its first templates; the order of templates depends on the condition.

    ``templates`` is a small fixed table (family, template_id, ordinal, normal_ordinal, ...), so the product never leaves the map side.
    """
    rank = F.when(F.col("condition") == "anomalous", F.col("ordinal") < per_anomalous).otherwise(F.col("normal_ordinal") < per_normal)
    return images.join(F.broadcast(templates), rank)


def weight_lookup(rows: DataFrame, weights: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(ident, score): the sum of the weights of a row's keys, 0 where none is known. ``rows``: ident and the keys, one row per key."""
    found = rows.join(weights.select(*keys, "w"), keys, "left")
    return found.groupBy(ident).agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("score"))
