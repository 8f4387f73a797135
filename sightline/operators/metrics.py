"""Classification, set-valued and spatial metrics. A null prediction is unparsed: no label of its own, but a miss of its truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vocabulary as V
from sightline.functions.text import ColumnOrName, col
from sightline.storage import cut_lineage

UNPARSED = "__unparsed__"


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b as a double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of the cells that occur; a null prediction is UNPARSED."""
    pair = df.filter(F.col(truth).isNotNull()).select(F.col(truth).alias("truth"), F.coalesce(F.col(predicted), F.lit(UNPARSED)).alias("predicted"))
    return cut_lineage(pair.groupBy("truth", "predicted").agg(F.count("*").alias("n")), "cells")  # as many rows as pairs of labels, and read more than once


def confusion_dense(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Every truth with every predicted value, zeros included. Both spines are as small as the confusion itself."""
    cells = confusion(df, truth, predicted)
    columns = cells.agg(F.collect_set("predicted").alias("c"))  # one row: the labels that occur
    spine = cells.select("truth").distinct().join(F.broadcast(columns)).select("truth", F.explode("c").alias("predicted"))
    return spine.join(cells, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_ranked(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Off-diagonal cells with their rank by (count descending, truth, predicted)."""
    from pyspark.sql import Window

    cells = confusion(df, truth, predicted).filter("truth <> predicted")
    order = Window.orderBy(F.desc("n"), "truth", "predicted")  # as many rows as pairs of labels
    return cells.withColumn("rank", F.row_number().over(order).cast("bigint"))


def classification_by_label(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label of truths and predictions: tp, fp, fn, support, precision, recall, f1. One pass, then only label-sized tables."""
    return _by_label(confusion(df, truth, predicted))


def _by_label(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select("n", hit.alias("hit"), F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_truth")))).alias("s"))
    per = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.is_truth"), F.col("hit")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.is_truth"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("s.is_truth"), F.col("n")).otherwise(0)).alias("said")
    )
    per = per.filter(F.col("label") != UNPARSED)
    precision, recall = safe_divide("tp", "said"), safe_divide("tp", "support")
    rows = per.select("label", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support", precision.alias("precision"), recall.alias("recall"))
    return rows.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_overall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """count, accuracy, macro means over labels, unparsed count and rate."""
    cells = confusion(df, truth, predicted)
    whole = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct"), F.coalesce(F.sum(F.when(F.col("predicted") == UNPARSED, F.col("n"))), F.lit(0)).alias("unparsed"))
    macro = _by_label(cells).agg(*(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in ("precision", "recall", "f1")))
    return whole.join(F.broadcast(macro)).select("count", safe_divide("correct", "count").alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", "unparsed", safe_divide("unparsed", "count").alias("unparsed_rate"))  # one row each


def set_scores(truth: ColumnOrName, predicted: ColumnOrName) -> dict[str, Column]:
    """exact_match, precision, recall and f1 of two sets; two empty sets agree, one empty set scores 0."""
    t, p = col(truth), col(predicted)
    both, nt, np = F.size(F.array_intersect(t, p)), F.size(t), F.size(p)
    empty = (nt == 0) & (np == 0)
    precision, recall = F.when(empty, 1.0).otherwise(safe_divide(both, np)), F.when(empty, 1.0).otherwise(safe_divide(both, nt))
    return {
        "exact_match": (both == nt) & (both == np),
        "precision": precision,
        "recall": recall,
        "f1": F.when(empty, 1.0).otherwise(safe_divide(2 * both, nt + np)),
    }


def set_macro(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the set scores; zeros without rows; count is a double."""
    keys = by or []
    means = [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in ("exact_match", "precision", "recall", "f1")]
    return df.groupBy(*keys).agg(*means, F.count("*").cast("double").alias("count"))


def adjacent(truth: ColumnOrName, predicted: ColumnOrName) -> Column:
    """At most one cell apart in both directions; an unknown or null label is never adjacent."""
    at = F.create_map(*(F.lit(x) for i, name in enumerate(V.LOCATIONS) for x in (name, i)))
    a, b = F.try_element_at(at, col(truth)), F.try_element_at(at, col(predicted))
    rows, columns = F.abs(F.floor(a / 3) - F.floor(b / 3)), F.abs(a % 3 - b % 3)
    return F.coalesce((rows <= 1) & (columns <= 1), F.lit(False))
