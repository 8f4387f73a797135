"""Splits, quotas, floors and round-robins in an order given by sha256, so that no partitioning can change a result.

Ranks within tasks, strata or runs come from ``bottom_k`` and ``running_sum``, which split large groups; windows only see groups that a
quota or a label set bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.hashing import stable_key, tie_breaker, unit
from sightline.operators.ranking import bottom_k, running_sum
from sightline.storage import cut_lineage

SPLITS = ["train", "validation", "test"]


def largest_remainder(n: Column, train: float = 0.70, validation: float = 0.15) -> dict[str, Column]:
    """Integer counts per split: floors, then one more by (fraction, ratio) descending; train gets at least 1 of the larger of the others."""
    ratios = {"train": train, "validation": validation, "test": 1.0 - train - validation}
    exact = {s: n * F.lit(r) for s, r in ratios.items()}
    floor = {s: F.floor(e) for s, e in exact.items()}
    left = n - sum(floor.values(), F.lit(0))
    part = {s: exact[s] - floor[s] for s in ratios}

    def ahead(s: str) -> Column:
        """How many splits come before s."""
        before = F.lit(0)
        for i, o in enumerate(SPLITS):
            if o == s:
                continue
            tie = ratios[o] > ratios[s] or (ratios[o] == ratios[s] and i < SPLITS.index(s))
            before = before + ((part[o] > part[s]) | ((part[o] == part[s]) & F.lit(tie))).cast("int")
        return before

    got = {s: (floor[s] + (ahead(s) < left).cast("int")) for s in SPLITS}
    needy = (n > 0) & (got["train"] == 0)
    from_validation = needy & (got["validation"] >= got["test"]) & (got["validation"] > 0)
    from_test = needy & ~(got["validation"] >= got["test"]) & (got["test"] > 0)
    return {
        "train": (got["train"] + (from_validation | from_test).cast("int")).cast("bigint"),
        "validation": (got["validation"] - from_validation.cast("int")).cast("bigint"),
        "test": (got["test"] - from_test.cast("int")).cast("bigint"),
    }


def duplicate_clusters(images: DataFrame, ordinal: str) -> DataFrame:
    """One row per cluster of equal digests (an image without one is its own): key, representative (first member), members, strata."""
    key = F.when(F.col("sha256").isNotNull(), F.concat(F.lit("sha256:"), F.col("sha256"))).otherwise(F.concat(F.lit("id:"), F.col("image_id")))
    stratum = F.concat_ws("|", "category", "condition")
    return images.withColumn("cluster", key).groupBy("cluster").agg(
        F.min_by(F.struct("image_id", "category", "condition", "defect_type"), F.struct(ordinal, "image_id")).alias("first"), F.count("*").alias("members"), F.count_distinct(stratum).alias("strata")
    ).select("cluster", "first.*", "members", "strata")


def defect_round_robin(rows: DataFrame, seed: int, ident: str) -> DataFrame:
    """Adds ``position`` within (category, condition): defects take turns, large ones first, ties by hash of the label.

    A row's round is its rank in its defect. Its position follows from the sizes of the stratum's defects alone: all rows of
    earlier rounds, and those of its own round whose defect comes first. No task has to see a whole stratum.
    """
    label = F.when(F.col("condition") == "normal", "normal").otherwise(F.coalesce(F.nullif(F.col("defect_type"), F.lit("")), F.lit("unspecified_anomaly")))
    stratum = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("condition", F.lit("")))
    keyed = rows.withColumn("defect_key", label).withColumn("__s", stratum).withColumn("__h", tie_breaker(F.lit(seed), ident)).withColumn("__u", unit(F.col("__h"))).withColumn("__one", F.lit(1))
    ranked = running_sum(keyed, ["__s", "defect_key"], "__u", ["__h", ident], "__one", "__before")
    sizes = keyed.groupBy("__s", "defect_key").agg(F.count("*").alias("size")).withColumn("__d", tie_breaker(F.lit(seed), "defect_key"))
    lists = sizes.groupBy("__s").agg(F.collect_list(F.struct("size", "__d")).alias("__sizes"))  # one entry per label
    own = sizes.join(lists, "__s")
    placed = ranked.join(own, ["__s", "defect_key"]).withColumn("round", (F.col("__before") + 1).cast("bigint"))
    earlier = F.aggregate("__sizes", F.lit(0).cast("bigint"), lambda acc, x: acc + F.least(x["size"], F.col("round") - 1))
    first = F.size(F.filter("__sizes", lambda x: (x["size"] >= F.col("round")) & ((x["size"] > F.col("size")) | ((x["size"] == F.col("size")) & (x["__d"] < F.col("__d"))))))
    return placed.withColumn("position", (earlier + first + 1).cast("bigint")).select(*rows.columns, "defect_key", "size", "round", "position")


def contiguous_split(ranked: DataFrame) -> DataFrame:
    """Of each stratum the first targets by ``position`` train, the next validation, the rest test."""
    sizes = ranked.groupBy("category", "condition").agg(F.count("*").alias("n"))
    targets = sizes.select("category", "condition", *(c.alias(f"n_{s}") for s, c in largest_remainder(F.col("n")).items()))
    split = F.when(F.col("position") <= F.col("n_train"), "train").when(F.col("position") <= F.col("n_train") + F.col("n_validation"), "validation").otherwise("test")
    targets = targets.withColumnsRenamed({"category": "t_category", "condition": "t_condition"})
    same = F.col("category").eqNullSafe(F.col("t_category")) & F.col("condition").eqNullSafe(F.col("t_condition"))
    return ranked.join(targets, same).drop("t_category", "t_condition").withColumn("split", split)


def assign_splits(images: DataFrame, ordinal: str, seed: int = 42) -> DataFrame:
    """(image_id, cluster, split): stratified, rare defects early, equal images together."""
    clusters = duplicate_clusters(images, ordinal)
    split = contiguous_split(defect_round_robin(clusters, seed, "cluster")).select("cluster", "split")
    key = F.when(F.col("sha256").isNotNull(), F.concat(F.lit("sha256:"), F.col("sha256"))).otherwise(F.concat(F.lit("id:"), F.col("image_id")))
    return images.select("image_id", key.alias("cluster")).join(split, "cluster")


def quota_sample(rows: DataFrame, quotas: DataFrame, group: str, ident: str, seed: int, salt: str = "") -> DataFrame:
    """Per group the ``quota`` rows that come first by sha256 of ``seed:ident``. ``quotas``: group, quota."""
    keyed = rows.join(quotas, group).withColumn("__u", unit(tie_breaker(F.lit(f"{seed}{salt}"), ident)))
    return bottom_k(keyed, [group], "__u", [ident], "quota").drop("__u", "quota")


def require_quotas(rows: DataFrame, quotas: DataFrame, group: str) -> None:
    """Raises for groups with fewer rows than their quota."""
    short = quotas.join(rows.groupBy(group).agg(F.count("*").alias("n")), group, "left").filter("coalesce(n, 0) < quota").select(group).limit(10).collect()
    if short:
        raise ValueError(f"not enough rows for {[r[0] for r in short]}")


def limit_sample(rows: DataFrame, n: int | None, ident: str, seed: int) -> DataFrame:
    """The n rows that come first by sha256; all for null or more than there are."""
    keyed = rows.withColumn("__u", unit(tie_breaker(F.lit(seed), ident))).withColumn("__g", F.lit(0)).withColumn("__k", F.lit(n).cast("bigint"))
    return bottom_k(keyed, ["__g"], "__u", [ident], "__k").drop("__u", "__g", "__k")


def hard_rank(rows: DataFrame, seed: int, by: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank by (score descending, sha256 of seed:instruction_id)."""
    best = _best(rows.withColumn("__k", F.lit(most).cast("bigint")), [by], "__k", seed)
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie_breaker(F.lit(seed), "instruction_id"))  # most rows per group
    return best.drop("__k").withColumn("rank", F.row_number().over(w).cast("bigint"))


def _best(rows: DataFrame, group: list[str], k: str, seed: int) -> DataFrame:
    """Per group the ``k`` rows that come first by (score descending, hash).

    Rows per score are counted first, which tells the score at which a group is cut. All above it are taken; those of that score, nearly a whole
    group where most scores are equal, are split by their hash.
    """
    sizes = rows.groupBy(*group, "score").agg(F.count("*").alias("__n"), F.max(F.col(k).cast("bigint")).alias("__most"))
    upto = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per distinct score
    reached = F.sum("__n").over(upto) >= F.col("__most")
    cuts = cut_lineage(sizes.withColumn("__reached", reached).groupBy(*group).agg(F.max(F.when(F.col("__reached"), F.col("score"))).alias("__cut")), "score-cuts")
    keyed = rows.join(cuts, group).filter("__cut IS NULL OR score >= __cut").withColumn("__h", tie_breaker(F.lit(seed), "instruction_id"))
    keyed = keyed.withColumn("__key", ((F.coalesce(F.col("score") == F.col("__cut"), F.lit(False))).cast("int") + unit(F.col("__h"))) / 2).withColumn("__low", -F.col("score"))
    return bottom_k(keyed, group, "__key", ["__low", "__h"], k).select(*rows.columns)


def category_floor(rows: DataFrame, floor: int, seed: int) -> DataFrame:
    """Of each task and category the ``floor`` hardest rows."""
    return _best(rows.withColumn("__k", F.lit(floor).cast("bigint")), ["task_family", "category"], "__k", seed).drop("__k")


def floor_then_fill(rows: DataFrame, quotas: DataFrame, seed: int, floor: int, by: list[str] | None = None) -> DataFrame:
    """Per group the ``floor`` hardest rows of each category, then the hardest of the rest up to ``quota``.

    ``rows``: instruction_id, task_family, condition, category, score, none of them null; ``by``: the columns that quotas are given for, task_family or
    task_family and condition. Raises where floors alone exceed a quota.
    """
    keys = by or ["task_family"]
    asked = rows.join(quotas.select(*keys).distinct(), keys, "left_semi")
    floors = cut_lineage(category_floor(asked, floor, seed), "floors")
    room = quotas.join(floors.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").select(*keys, (F.col("quota") - F.coalesce("n", F.lit(0))).alias("room"))
    over = room.filter("room < 0").limit(1).collect()
    if over:
        raise ValueError(f"the floor exceeds the quota of {[over[0][k] for k in keys]}")
    rest = asked.join(floors.select("instruction_id", "task_family"), ["instruction_id", "task_family"], "left_anti").join(room, keys)
    filled = cut_lineage(_best(cut_lineage(rest, "rest"), keys, "room", seed).select(*rows.columns), "filled")
    return floors.select(*rows.columns).withColumn("is_floor", F.lit(True)).unionByName(filled.withColumn("is_floor", F.lit(False)))


STRATUM = ["category", "condition", "defect_type", "location", "visual_severity"]


def unique_first_round_robin(rows: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """A quota sample per task that takes new images first.

    ``rows``: instruction_id, image_id, task_family and STRATUM. Strata take turns in the order of their hash. The first pass takes a
    row per turn whose image wasn't taken yet, the second fills up with the rest. All rows of an image lie in one stratum, so
    "not taken yet" means "first of its image in the hash order", and both passes are ranks.
    """
    parts = [F.coalesce(F.col(c), F.lit("none")).alias(c) for c in STRATUM]
    asked = rows.join(quotas, "task_family").select("instruction_id", "image_id", "task_family", "quota", *parts)
    keyed = asked.withColumn("k", stable_key(F.lit(seed), "task_family", *STRATUM, "instruction_id")).withColumn("s", stable_key(F.lit(seed), "task_family", *STRATUM))
    firsts = keyed.groupBy("task_family", "image_id").agg(F.min("k").alias("first"))
    last = keyed.join(firsts.select("task_family", F.col("first").alias("k")), ["task_family", "k"], "left_semi").groupBy("task_family", "s").agg(F.max("k").alias("last"))
    keyed = keyed.join(firsts, ["task_family", "image_id"]).join(last, ["task_family", "s"], "left").withColumn("is_first", F.col("k") == F.col("first"))
    # what lies behind the last first image was never deferred, so it comes before the deferred ones
    late = F.when(F.col("is_first"), 0).otherwise((F.col("k") < F.coalesce("last", F.lit(""))).cast("int"))
    keyed = keyed.withColumn("late", late).withColumn("u", (F.col("late") + unit(F.col("k"))) / 2).withColumn("one", F.lit(1))
    turns = running_sum(keyed, ["task_family", "s", "is_first"], "u", ["late", "k"], "one", "before").filter(F.col("before") < F.col("quota"))
    # the first quota rows by pass, turn and stratum, without a task that sees those of all strata
    turns = turns.withColumn("__key", ((~F.col("is_first")).cast("int") + F.col("before") / F.greatest("quota", F.lit(1))) / 2)
    turns = bottom_k(cut_lineage(turns, "turns"), ["task_family"], "__key", ["s"], "quota")
    order = Window.partitionBy("task_family").orderBy(F.desc("is_first"), "before", "s")  # quota rows per task
    return turns.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= quota").select("instruction_id", "image_id", "task_family", *STRATUM, "rank")


def stratified_round_robin(rows: DataFrame, by: list[str], n: int, seed: int, ident: str) -> DataFrame:
    """n rows, strata taking turns in the order of their keys; within a stratum by hash.

    Unlike a loop over a shrinking list of keys no stratum is ever skipped.
    """
    keyed = rows.withColumn("__h", tie_breaker(F.lit(seed), ident)).withColumn("__u", unit(F.col("__h"))).withColumn("__one", F.lit(1))
    ranked = running_sum(keyed, by, "__u", ["__h", ident], "__one", "__turn")
    return ranked.filter(F.col("__turn") < n).orderBy("__turn", *by).limit(n).select(*rows.columns)


def shuffled_like_mt19937(rows: DataFrame, by: str, ordinal: str, seed: int) -> DataFrame:
    """Adds ``position``: the place of each row after a Mersenne Twister shuffle of its group in file order.

    For parity with samples that were drawn so. One group is one task, so groups must be small; a group's rows must fit a worker.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        pdf = pdf.sort_values(ordinal)
        index = list(range(len(pdf)))
        random.Random(seed).shuffle(index)
        return pdf.iloc[index].assign(position=range(len(pdf)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(by).applyInPandas(one, f"{schema}, position bigint")


def ranked_in_order(rows: DataFrame, by: str, ident: str) -> DataFrame:
    """Adds ``rank``, from 1: the place of each row by (``by``, ``ident``). ``by`` has few values, none of them null.

    Rows sorted by range are counted per partition; a partition's first rank is the count before it, so no task holds them all.
    """
    # written once and read twice, so that both see the same partitions
    placed = cut_lineage(rows.repartitionByRange(by, ident).withColumn("__part", F.spark_partition_id()), "ordered")
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by, ident))
    return placed.join(starts, "__part").withColumn("rank", (F.col("__before") + place).cast("bigint")).select(*rows.columns, "rank")


def newest_or_best(checkpoints: DataFrame, keep: int) -> DataFrame:
    """(location, step, is_best): the newest ``keep`` steps of each location and the best ones."""
    w = Window.partitionBy("location").orderBy(F.desc("step"))
    return checkpoints.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("is_best") | (F.col("rank") <= keep))


def exact_three_decimals(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: value as text with three decimals of its exact binary value, ties to even, which no built-in function gives."""
    import pandas as pd

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [None if pd.isna(x) else f"{x:.3f}" for x in b[value]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(render, f"{schema}, `{out}` string")
