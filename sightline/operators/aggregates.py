"""Counts, percentiles, duplicates, leakage and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_1d(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, n) of several dimensions in one pass; nulls are a value."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    # each row is expanded after a first count per combination, so only combinations are shuffled twice
    combos = df.groupBy(*dims).agg(F.count("*").alias("n"))
    return combos.select("n", F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.sum("n").alias("n"))


def counts_2d(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) and both margins, a margin's other side being null and its level below 2 (grouping sets)."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")).filter("level < 3")


def split_stats(df: DataFrame, split: str, dims: list[str], splits: list[str]) -> DataFrame:
    """Rows of each split per dimension value; empty splits are listed with 0 and a null value."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims))
    combos = df.groupBy(split, *dims).agg(F.count("*").alias("n"))
    found = combos.select(F.col(split).alias("split"), "n", F.explode(pairs).alias("p")).groupBy("split", "p.dim", "p.value").agg(F.sum("n").alias("n"))
    spine = df.sparkSession.createDataFrame([(s, d) for s in splits for d in dims], "split string, dim string")
    return spine.join(found, ["split", "dim"], "left").select("split", "dim", "value", F.coalesce("n", F.lit(0)).alias("n"))


def min_max_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("n"))


PERCENTS = (0.90, 0.95, 0.99)


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """min, true median, nearest-rank p90, p95 and p99 (index half to even), max and mean of a long column; zeros when empty.

    Equal values are counted first; ranks then come from running counts over the distinct values, so no task holds all values.
    """
    from sightline.operators.ranking import running_sum

    each = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    whole = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("count"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v").cast("double") * F.col("c")).alias("total"))
    placed = each.join(F.broadcast(whole)).withColumn("g", F.lit(0))  # whole: one row
    # on a log scale, so that one very large value doesn't put all others into one bucket
    placed = placed.withColumn("key", F.coalesce(F.try_divide(F.log1p((F.col("v") - F.col("low")).cast("double")), F.log1p((F.col("high") - F.col("low") + 1).cast("double"))), F.lit(0.0)))
    placed = running_sum(placed, ["g"], "key", ["v"], "c", "before")

    def at(index: Column) -> Column:
        """The value at a zero-based rank."""
        return F.min(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("c")), F.col("v")))

    last = F.col("count") - 1
    out = placed.agg(
        F.max("count").alias("count"), F.min("v").alias("min"), at(F.floor(last / 2)).alias("m1"), at(F.ceil(last / 2)).alias("m2"),
        *(at(F.bround(last * F.lit(p)).cast("bigint")).alias(f"p{round(p * 100)}") for p in PERCENTS), F.max("v").alias("max"), (F.max("total") / F.max("count")).alias("mean"),
    )
    zero = F.lit(0).cast("bigint")
    return out.select(F.coalesce("count", zero).alias("count"), F.coalesce("min", zero).alias("min"), F.coalesce((F.col("m1") + F.col("m2")) / 2, F.lit(0.0)).alias("median"), *(F.coalesce(f"p{round(p * 100)}", zero).alias(f"p{round(p * 100)}") for p in PERCENTS), F.coalesce("max", zero).alias("max"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def repeated(df: DataFrame, value: str) -> DataFrame:
    """(value, n) of values that occur more than once."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_summary(df: DataFrame, value: str) -> DataFrame:
    """Unique values, repeated ones, rows in repeated ones and the largest frequency (1 if none repeats)."""
    each = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("unique_values"), F.count_if(F.col("n") > 1).alias("repeated_values"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeated"), F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("max_frequency"))


def top_repeated(df: DataFrame, value: str, k: int = 25) -> DataFrame:
    """The k most frequent repeated values, ties by value."""
    return repeated(df, value).orderBy(F.desc("n"), "value").limit(k)


def cross_split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the sorted splits. Null keys and splits don't count."""
    found = df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(split)).alias("s"))
    return found.filter(F.size("s") > 1).select("key", F.array_join("s", ",").alias("splits"))


def fingerprint(df: DataFrame, ident: str, by: list[str]) -> DataFrame:
    """sha256 of the sorted identifiers, each followed by a newline, per group.

    The digest of a list needs the list in one place: use it for selections, whose size is their quota, not for whole corpora;
    ``corpus_fingerprint`` is for those.
    """
    ordered = F.array_join(F.array_sort(F.collect_list(ident)), "\n")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat(ordered, F.lit("\n")), 256).alias("fingerprint"))


def corpus_fingerprint(df: DataFrame, ident: str, by: list[str], buckets: int = 4096) -> DataFrame:
    """A digest of any number of identifiers: sha256 over the fingerprints of hash buckets, so no task holds more than a bucket."""
    digest = F.sha2(F.col(ident), 256)
    parts = df.withColumn("__b", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)))
    each = fingerprint(parts, ident, [*by, "__b"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "fingerprint"))), lambda x: x["fingerprint"]), "\n")
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("fingerprint"))


def selection_audit(records: DataFrame, runs: DataFrame) -> DataFrame:
    """What each training run selects: (run_id, selection, kind, task_family, value, n, fingerprint).

    ``records``: split, instruction_id, image_id, task_family, category, condition; ``runs``: run_id, subset_seed, train_limit, validation_limit,
    train_task_quotas. Train takes its quotas, else its limit, validation its limit with the next seed, each the first by sha256. Kinds: records
    (with the digest of its identifiers), ids, images, source (the split that is selected from), and counts by task, category and condition.
    A run whose quotas exceed the supply selects nothing: it has short_quota rows (value: the quota, n: the supply) instead.
    """
    from sightline.functions.hashing import tie_breaker, unit
    from sightline.operators.ranking import bottom_k
    from sightline.storage import bounded_rows, cut_lineage

    spark, asked, spine = records.sparkSession, [], []
    for r in bounded_rows(runs.select("run_id", "subset_seed", "train_limit", "validation_limit", "train_task_quotas"), what="train_runs"):
        spine += [(r.run_id, "train"), (r.run_id, "validation")]
        asked.append((r.run_id, "validation", r.subset_seed + 1, None, r.validation_limit))
        quotas = r.train_task_quotas
        asked += [(r.run_id, "train", r.subset_seed, None, r.train_limit)] if quotas is None else [(r.run_id, "train", r.subset_seed, t, k) for t, k in quotas.items()]
    limits = cut_lineage(spark.createDataFrame(asked, "run_id string, selection string, seed bigint, asked_task string, k bigint"), "limits")
    supply = records.filter("split = 'train' AND task_family IS NOT NULL").groupBy(F.col("task_family").alias("asked_task")).agg(F.count("*").alias("n"))
    short = limits.filter("asked_task IS NOT NULL").join(supply, "asked_task", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).filter("n < k")
    short = cut_lineage(short.select("run_id", "selection", "asked_task", "k", "n"), "short")
    whole = lambda df: df.join(short.select("run_id").distinct(), "run_id", "left_anti")

    limits = F.broadcast(whole(limits))  # bounded above
    mine = (F.col("split") == F.col("selection")) & (F.col("asked_task").isNull() | (F.col("asked_task") == F.col("task_family")))
    keyed = records.join(limits, mine).withColumn("__g", F.coalesce("asked_task", F.lit(""))).withColumn("__u", unit(tie_breaker(F.col("seed"), "instruction_id")))
    keyed = keyed.select("run_id", "selection", "__g", "__u", "k", *(c for c in records.columns if c != "split"))
    by = ["run_id", "selection"]
    taken = cut_lineage(bottom_k(keyed, [*by, "__g"], "__u", ["instruction_id"], "k").drop("__g", "__u", "k"), "selected")

    none = F.lit(None).cast("string")
    row = lambda kind, task, value, n, digest: F.struct(F.lit(kind).alias("kind"), task.alias("task_family"), value.alias("value"), n.alias("n"), digest.alias("fingerprint"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    heads = whole(spark.createDataFrame(spine, "run_id string, selection string")).join(corpus_fingerprint(taken, "instruction_id", by), by, "left")
    sizes = taken.groupBy(*by).agg(F.count_distinct("instruction_id").alias("ids"), F.count_distinct("image_id").alias("images"))
    source = corpus_fingerprint(records, "instruction_id", ["split"]).toDF("selection", "source_n", "source_print")
    heads = heads.join(sizes, by, "left").join(source, "selection", "left")
    heads = heads.select(*by, F.explode(F.array(row("records", none, none, zero(F.col("n")), F.col("fingerprint")), row("ids", none, none, zero(F.col("ids")), none), row("images", none, none, zero(F.col("images")), none), row("source", none, none, zero(F.col("source_n")), F.col("source_print")))).alias("r"))
    combos = cut_lineage(taken.groupBy(*by, "task_family", "category", "condition").agg(F.count("*").alias("n")), "combos")
    n, task = F.col("n"), F.col("task_family")
    cells = [row("task_family", none, task, n, none), *(row(c, none, F.col(c), n, none) for c in ("category", "condition")), *(row(f"task_{c}", task, F.col(c), n, none) for c in ("category", "condition"))]
    counts = combos.select(*by, F.explode(F.array(*cells)).alias("r")).select(*by, "r.*").groupBy(*by, "kind", "task_family", "value").agg(F.sum("n").alias("n")).withColumn("fingerprint", none)
    missing = short.select(*by, F.lit("short_quota").alias("kind"), F.col("asked_task").alias("task_family"), F.col("k").cast("string").alias("value"), "n", none.alias("fingerprint"))
    return heads.select(*by, "r.*").unionByName(counts).unionByName(missing)


def all_true(c: Column) -> Column:
    """True for no rows, as the all of an empty list."""
    return F.coalesce(F.bool_and(c), F.lit(True))


def any_true(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def expected_counts(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ from what is expected, either way. Both: key, n."""
    both = expected.select(key, F.col("n").alias("expected")).join(found.select(key, F.col("n").alias("found")), key, "full_outer")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).filter("expected <> found")
