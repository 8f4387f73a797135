"""Exact ranks and running sums that keep no group in one task, however large it is.

Both operators cut the order key, a double in [0, 1), into buckets. Bucket totals are small, are added up on the map
side, and tell where a group's rows have to be looked at one by one: in a single bucket for the bottom k, within each
bucket for a running sum. Results equal a window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.storage import cut_lineage

BUCKETS = 4096


def bucket_of(key: Column, buckets: int) -> Column:
    return F.least(F.floor(key * buckets), F.lit(buckets - 1)).cast("int")


def bottom_k(df: DataFrame, group: list[str], key: str, ties: list[str], k: str, buckets: int = BUCKETS) -> DataFrame:
    """Of each group the ``k`` rows that come first by (key, ties).

    ``key`` is a column of doubles in [0, 1), ``k`` a column with one value per group (null: all rows). Group columns must
    not be null, and (key, ties) must tell the rows of a group apart. Bucket totals give each group's last bucket, the rows of that bucket
    its last row, and a scan takes what comes up to there. The input is read three times, so pass a table rather than a long plan.
    """
    at, last = "__rank_b", F.struct(key, *ties)
    rows = df.withColumn(at, bucket_of(F.col(key), buckets))
    sums = rows.groupBy(*group, at).agg(F.count("*").alias("__rank_n"), F.max(F.col(k).cast("bigint")).alias("__rank_k"))
    upto = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("__rank_before") + F.col("__rank_n") > F.col("__rank_k")
    cuts = (
        sums.withColumn("__rank_before", F.coalesce(F.sum("__rank_n").over(upto), F.lit(0)))
        .groupBy(*group)
        .agg(F.min(F.when(over, F.struct(F.col(at).alias("cut"), (F.col("__rank_k") - F.col("__rank_before")).alias("rest")))).alias("__rank_c"))
        .select(*group, F.coalesce("__rank_c.cut", F.lit(buckets)).alias("__rank_cut"), F.col("__rank_c.rest").alias("__rank_rest"))
    )
    # as tables their size is known before the joins are planned, so that few groups are broadcast and rows need no shuffle
    cuts = cut_lineage(cuts, "cuts")
    edge = rows.join(cuts, group).filter(F.col(at) == F.col("__rank_cut")).select(*group, "__rank_rest", last.alias("__rank_last"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__rank_last"))  # one bucket per group
    ends = edge.withColumn("__rank_r", place).filter(F.col("__rank_r") == F.col("__rank_rest")).select(*group, "__rank_last")
    limits = cut_lineage(cuts.drop("__rank_rest").join(ends, group, "left"), "limits")
    taken = (F.col(at) < F.col("__rank_cut")) | ((F.col(at) == F.col("__rank_cut")) & (last <= F.col("__rank_last")))
    return rows.join(limits, group).filter(taken).select(*df.columns)


def running_sum(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group that come before the row by (key, ties)."""
    buckets_of = df.withColumn("__rank_b", bucket_of(F.col(key), buckets))
    upto = Window.partitionBy(*group).orderBy("__rank_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets_of.groupBy(*group, "__rank_b").agg(F.sum(value).alias("__rank_s"))
    starts = starts.select(*group, "__rank_b", F.coalesce(F.sum("__rank_s").over(upto), F.lit(0)).alias("__rank_start"))
    within = Window.partitionBy(*group, "__rank_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        buckets_of.join(cut_lineage(starts, "starts"), [*group, "__rank_b"])
        .withColumn(out, F.col("__rank_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .select(*df.columns, out)
    )
