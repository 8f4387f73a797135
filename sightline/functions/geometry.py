"""Shapes of masks: boxes, centroids, grid cells, severity, and the consistency of derived rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vocabulary as V
from sightline.functions.text import ColumnOrName, col


def nine_grid(x_normalized: ColumnOrName, y_normalized: ColumnOrName) -> Column:
    """The grid cell of a point; coordinates in [0, 1)."""
    cell = [F.least(F.floor(col(v) * 3), F.lit(2)).cast("int") for v in (y_normalized, x_normalized)]
    return F.get(F.array(*map(F.lit, V.LOCATIONS)), cell[0] * 3 + cell[1])


def severity(ratio: ColumnOrName, defect: ColumnOrName) -> Column:
    """minor, moderate or major by area; major whenever the label holds a keyword."""
    label = F.replace(F.lower(F.coalesce(col(defect), F.lit(""))), F.lit("_"), F.lit(" "))
    keyword = reduce(lambda a, b: a | b, [F.contains(label, F.lit(k)) for k in V.MAJOR_KEYWORDS])
    return F.when(keyword, "major").when(col(ratio) < V.MINOR_BELOW, "minor").when(col(ratio) < V.MODERATE_BELOW, "moderate").otherwise("major")


def severity_basis(defect: ColumnOrName) -> Column:
    label = F.replace(F.lower(F.coalesce(col(defect), F.lit(""))), F.lit("_"), F.lit(" "))
    keyword = reduce(lambda a, b: a | b, [F.contains(label, F.lit(k)) for k in V.MAJOR_KEYWORDS])
    return F.when(keyword, "defect_keyword_override").otherwise("area_ratio")


def mask_features(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Box, centroid and area of the foreground (v > 0) of each mask.

    ``pixels``: image_id, x, y, v; ``sizes``: image_id, width, height. One aggregation with map-side combine; a mask without
    foreground has no row.
    """
    shape = pixels.filter("v > 0").groupBy("image_id").agg(
        F.count("*").alias("area"), F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )
    return shape.join(sizes, "image_id").select(
        "image_id", "area", (F.col("area") / (F.col("width").cast("double") * F.col("height"))).alias("ratio"),
        "x_min", "y_min", "x_max", "y_max", (F.col("x_max") - F.col("x_min") + 1).alias("box_width"), (F.col("y_max") - F.col("y_min") + 1).alias("box_height"),
        (F.col("x_min") / F.col("width")).alias("x_min_normalized"), (F.col("y_min") / F.col("height")).alias("y_min_normalized"),
        ((F.col("x_max") + 1) / F.col("width")).alias("x_max_normalized"), ((F.col("y_max") + 1) / F.col("height")).alias("y_max_normalized"),
        F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("cx") / F.col("width")).alias("x_normalized"), (F.col("cy") / F.col("height")).alias("y_normalized"),
    )


def mask_histogram(pixels: DataFrame) -> DataFrame:
    """Foreground pixels, all pixels, sorted values and whether just one positive value occurs, per mask."""
    values = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    each = values.groupBy("image_id").agg(
        F.sum(F.when(F.col("v") > 0, F.col("n")).otherwise(0)).alias("foreground_pixels"), F.sum("n").alias("pixels"),
        F.array_sort(F.collect_set("v")).alias("unique_values"), (F.count_if(F.col("v") > 0) == 1).alias("is_binary"), (F.count_if(F.col("v") == 0) > 0).alias("has_background"),
    )
    return each.withColumn("foreground_ratio", F.col("foreground_pixels") / F.col("pixels"))


def derived_problems(row: dict[str, Column]) -> Column:
    """Sorted names of the rules that a derived image row breaks.

    ``row``: condition, area, ratio, box (struct), centroid (struct), location, severity.
    """
    normal, spatial = row["condition"] == "normal", F.coalesce(row["box"].isNotNull() & row["centroid"].isNotNull() & row["location"].isNotNull(), F.lit(False))
    none = row["box"].isNull() & row["centroid"].isNull() & row["location"].isNull()
    rules = {
        "normal_with_area": normal & ((row["area"] != 0) | (row["ratio"] != 0)),
        "normal_with_features": normal & ~none,
        "normal_with_severity": normal & ~row["severity"].eqNullSafe(F.lit("none")),
        "anomalous_without_area": (row["condition"] == "anomalous") & ~F.coalesce(row["area"] > 0, F.lit(False)),
        "anomalous_without_features": (row["condition"] == "anomalous") & ~spatial,
        "anomalous_without_severity": (row["condition"] == "anomalous") & F.coalesce(row["severity"] == "none", F.lit(True)),
        "box_width": row["box"]["width"] != row["box"]["x_max"] - row["box"]["x_min"] + 1,
        "box_height": row["box"]["height"] != row["box"]["y_max"] - row["box"]["y_min"] + 1,
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()))))
