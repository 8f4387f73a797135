"""Reproducible samples that stay stable as data grows: permanent random numbers.

The store keeps for each identifier a uniform number and the cohort of its first sight. A call inserts the identifiers that the store doesn't hold with one
anti-join and never changes a row. The number is drawn from the identifier's digest, so that a lost store can be filled again with the same numbers. A seed
sets the point of the unit circle from which numbers are read: a record's value under a seed is its number less that point. Records are selected by
(cohort, value), up to the threshold of their run: the pair of the L-th record for a limit of L. New cohorts only ever come in behind all older ones, so a
threshold never falls as snapshots are added, and what was picked stays picked. Thresholds are persisted beside the numbers. A store
that is kept from run to run also shields picks from records that arrive late: what is new to it comes after all that it holds. Runs
with one seed and a smaller limit take a subset.

Cohorts are counted first: those before the one in which a limit is reached are taken whole, and only that one is ranked, split by value (``bottom_k``).

Defined results: rows without an identifier, without split train or without delivery time are never selected; a null limit
takes all; a null seed counts as 0; a limit of 0 or less takes none; repeated deliveries count once, at the earliest.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform, unit
from sightline.functions.text import canonical_id, canonical_split
from sightline.operators.ranking import bottom_k
from sightline.storage import bounded_rows, cut_lineage, scratch_path

STORE_SCHEMA = "instruction_id string, number double, cohort int"
THRESHOLD_SCHEMA = "run_id string, seed bigint, snapshot_no int, cohort int, value double"
MAX_SNAPSHOTS, MAX_RUNS = 1_000, 1_000


class PermanentStore:
    """The persisted tables of identifiers with their numbers, and of thresholds; appended to, never rewritten."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], STORE_SCHEMA).write.mode("append").parquet(f"{path}/numbers")
        spark.createDataFrame([], THRESHOLD_SCHEMA).write.mode("append").parquet(f"{path}/thresholds")

    def read(self) -> DataFrame:
        return self.spark.read.schema(STORE_SCHEMA).parquet(f"{self.path}/numbers")

    def thresholds(self) -> DataFrame:
        return self.spark.read.schema(THRESHOLD_SCHEMA).parquet(f"{self.path}/thresholds")

    def next_cohort(self) -> int:
        last = self.read().agg(F.max("cohort")).first()[0]
        return 0 if last is None else last + 1

    def insert(self, ids: DataFrame, cohort: Column | int) -> None:
        """Give every identifier that isn't stored yet its number; ``cohort`` may depend on the row. Running it again changes nothing."""
        asked = ids.withColumn("cohort", cohort if isinstance(cohort, Column) else F.lit(cohort)).filter("instruction_id IS NOT NULL")
        fresh = asked.groupBy("instruction_id").agg(F.min("cohort").cast("int").alias("cohort")).join(self.read(), "instruction_id", "left_anti")
        fresh.select("instruction_id", unit(F.sha2("instruction_id", 256)).alias("number"), "cohort").write.mode("append").parquet(f"{self.path}/numbers")

    def note(self, thresholds: DataFrame) -> None:
        thresholds.select("run_id", "seed", "snapshot_no", "cohort", "value").write.mode("append").parquet(f"{self.path}/thresholds")


def first_deliveries(instructions: DataFrame) -> DataFrame:
    """Train records with the time of their earliest train delivery."""
    rows = instructions.select(canonical_id("instruction_id").alias("instruction_id"), canonical_split("dataset_split").alias("split"), "delivered_at")
    return rows.filter("split = 'train' AND instruction_id IS NOT NULL AND delivered_at IS NOT NULL").groupBy("instruction_id").agg(F.min("delivered_at").alias("first_at"))


def _cut(sizes: dict[int, int], limit: int | None) -> tuple[int, int | None]:
    """The last cohort that a limit reaches, and how many of it are taken (None: all). ``sizes``: records per cohort."""
    before = 0
    for cohort in sorted(sizes):
        if limit is not None and before + sizes[cohort] > limit:
            return cohort, max(limit - before, 0)
        before += sizes[cohort]
    return max(sizes, default=-1), None


def stable_samples(instructions: DataFrame, runs: DataFrame, snapshots: DataFrame, store_path: str | None = None) -> DataFrame:
    """(run_id, snapshot_no, instruction_id) of every run and snapshot."""
    spark = instructions.sparkSession
    times = bounded_rows(snapshots.filter("until_at IS NOT NULL").select("snapshot_no", "until_at").distinct().orderBy("until_at", "snapshot_no"), MAX_SNAPSHOTS, "snapshots")
    seen = first_deliveries(instructions)
    at = sum((F.when(F.col("first_at") > F.lit(t["until_at"]), 1).otherwise(0) for t in times), F.lit(0))  # the first snapshot that holds the record
    seen = cut_lineage(seen.select("instruction_id", at.alias("since")).filter(F.col("since") < len(times)), "p2-seen")
    store = PermanentStore(spark, store_path or scratch_path(spark, "p2-store"))
    start = store.next_cohort()  # identifiers that older runs stored stay ahead of all that are new to this one
    store.insert(seen, F.col("since") + start)
    pool = cut_lineage(store.read().join(seen, "instruction_id"), "p2-pool") if start else store.read().withColumn("since", F.col("cohort"))
    wanted = runs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.max("train_limit").cast("bigint").alias("k"), F.coalesce(F.max("subset_seed"), F.lit(0)).cast("bigint").alias("seed"))
    each = bounded_rows(wanted.orderBy("run_id"), MAX_RUNS, "runs")
    cells = pool.groupBy("since", "cohort").agg(F.count("*").alias("n")).collect()  # snapshots times cohorts
    asks = []
    for r in each:
        # with a fresh store records keep their rank at all snapshots that hold them, so the last one tells all
        for s in range(len(times)) if start else range(len(times) - 1, len(times)):
            sizes: dict[int, int] = defaultdict(int)
            for c in cells:
                if c["since"] <= s:
                    sizes[c["cohort"]] += c["n"]
            last, rest = _cut(sizes, r["k"])
            asks.append((r["run_id"], r["seed"], s, last, rest))
    asked = spark.createDataFrame(asks, "run_id string, seed bigint, s int, last int, rest bigint").withColumn("start_at", uniform("seed", F.lit("start")))  # MAX_RUNS times MAX_SNAPSHOTS at most
    turned = F.col("number") - F.col("start_at")
    rows = pool.join(F.broadcast(asked), (F.col("since") <= F.col("s")) & (F.col("cohort") <= F.col("last"))).withColumn("value", F.when(turned < 0, turned + 1).otherwise(turned))
    whole = rows.filter("cohort < last OR rest IS NULL")
    ranked = bottom_k(rows.filter("cohort = last AND rest IS NOT NULL"), ["run_id", "s"], "value", ["instruction_id"], "rest")
    picked = cut_lineage(whole.unionByName(ranked).select("run_id", "seed", "s", "cohort", "value", "since", "instruction_id"), "p2-picked")
    later = [(s, t, times[t]["snapshot_no"]) for s in range(len(times)) for t in ([s] if start else range(len(times)) if s == len(times) - 1 else [])]
    shown = F.broadcast(spark.createDataFrame(later, "s int, t int, snapshot_no int"))  # a row per snapshot
    out = picked.join(shown, "s").filter(F.col("since") <= F.col("t"))
    tops = picked.groupBy("run_id", "seed", "s", "since", "cohort").agg(F.max("value").alias("value")).join(shown, "s").filter(F.col("since") <= F.col("t"))
    tops = tops.groupBy("run_id", "seed", "snapshot_no").agg(F.max(F.struct("cohort", "value")).alias("top"))
    store.note(tops.select("run_id", "seed", "snapshot_no", "top.cohort", "top.value"))
    return out.select("run_id", "snapshot_no", "instruction_id")
