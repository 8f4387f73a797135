"""Deduplicated, canonical views of the domain tables, and the same as SQL.

A view takes the columns that its caller wants: one aggregation picks the winning row of a key and carries just these, so that the scan reads and the
shuffle moves nothing else. Without a list each column is an aggregate of its own, which lets the optimizer drop those that the query doesn't use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import canonical_id, canonical_split, canonical_token, strip
from sightline.operators.validate import message_fields


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _blank(c):
    return F.nullif(strip(c), F.lit(""))


def _winners(rows: DataFrame, keys: list[str], columns: list[str], wanted: tuple[str, ...], pick, order: Column) -> DataFrame:
    """Of each key the row that ``pick`` (min_by or max_by) finds by ``order``."""
    if not wanted:
        return rows.groupBy(*keys).agg(*(pick(F.col(c), order).alias(c) for c in columns))
    carried = [c for c in wanted if c not in keys]
    if not carried:
        return rows.select(*wanted).distinct()
    return rows.groupBy(*keys).agg(pick(F.struct(*carried), order).alias("r")).select(*keys, "r.*").select(*wanted)


def images(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per image: the first ingested."""
    digest = canonical_id("sha256")
    cols = {
        "image_id": canonical_token("image_id"), "category": canonical_token("category"), "condition": canonical_token("condition"), "defect_type": _blank("defect_type"),
        "nine_grid_location": canonical_token("nine_grid_location"), "visual_severity": canonical_token("visual_severity"), "anomaly_area_pixels": F.col("anomaly_area_pixels"), "anomaly_area_ratio": F.col("anomaly_area_ratio"),
        "sha256": F.when(digest.rlike("^[0-9a-f]{64}$") & (digest != "0" * 64), digest), "source_split": canonical_token("source_split"),
        "image_path": F.replace("image_path", F.lit("\\"), F.lit("/")), "width": F.col("width"), "height": F.col("height"), "ingested_at": F.col("ingested_at"), "annotation_row": F.col("annotation_row"),
    }
    rows = table(spark, d, "images").select(*(c.alias(k) for k, c in cols.items())).filter("image_id IS NOT NULL")
    order = F.struct("ingested_at", F.coalesce("annotation_row", F.lit(2**31 - 1)), F.coalesce("sha256", F.lit("~")), F.coalesce("defect_type", F.lit("~")))
    return _winners(rows, ["image_id"], [k for k in cols if k != "image_id"], wanted, F.min_by, order)


def records(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per instruction record: the latest delivery."""
    m = message_fields()
    cols = {
        "image_id": canonical_token("image_id"), "split": canonical_split("dataset_split"), "task_family": canonical_token("task_family"), "template_id": canonical_token("template_id"), "prompt": m["prompt"], "answer": m["answer"],
        "image": m["image"], "source": canonical_token("metadata.source"), "category": canonical_token("metadata.category"), "condition": canonical_token("metadata.condition"), "defect_type": _blank("metadata.defect_type"),
        "location": canonical_token("metadata.location"), "visual_severity": canonical_token("metadata.visual_severity"), "answer_format": canonical_token("metadata.answer_format"), "delivery_id": F.col("delivery_id"),
    }
    rows = table(spark, d, "instructions").select(canonical_id("instruction_id").alias("instruction_id"), F.col("delivered_at"), *(c.alias(k) for k, c in cols.items())).filter("instruction_id IS NOT NULL")
    return _winners(rows, ["instruction_id"], list(cols), wanted, F.max_by, F.struct("delivered_at", "delivery_id"))


def predictions(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """One row per run and instruction: the latest answer."""
    cols = {
        "image_id": canonical_token("image_id"), "task_family": canonical_token("task_family"), "category": canonical_token("category"), "condition": canonical_token("condition"), "defect_type": _blank("defect_type"),
        "location": canonical_token("location"), "visual_severity": canonical_token("visual_severity"), "prediction": F.col("prediction"), "error": F.col("error"), "generated_token_count": F.col("generated_token_count"), "prediction_no": F.col("prediction_no"),
    }
    rows = table(spark, d, "predictions").select("run_id", canonical_id("instruction_id").alias("instruction_id"), "generated_at_utc", *(c.alias(k) for k, c in cols.items())).filter("instruction_id IS NOT NULL AND run_id IS NOT NULL")
    return _winners(rows, ["run_id", "instruction_id"], list(cols), wanted, F.max_by, F.struct("generated_at_utc", "prediction_no"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumns({"source": canonical_token("source"), "lang": canonical_token("lang")})


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings read as masks of 8 x 8 pixels: (image_id, x, y, v)."""
    each = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return each.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.when(F.col("e") > 0.1, F.when(F.col("e") > 0.2, 2).otherwise(1)).otherwise(0).alias("v"))


# the same as SQL


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def token_sql(c: str) -> str:
    return rf"nullif(regexp_replace(lower({strip_sql(c)}), '[\s-]+', '_', 'g'), '')"


def id_sql(c: str) -> str:
    return f"nullif(lower({strip_sql(c)}), '')"


def blank_sql(c: str) -> str:
    return f"nullif({strip_sql(c)}, '')"


def split_sql(c: str) -> str:
    from sightline.functions.text import SPLIT_WORDS

    whens = " ".join(f"WHEN {token_sql(c)} IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in SPLIT_WORDS.items())
    return f"CASE {whens} END"


def _last(inner: str, keys: str, order: str) -> str:
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({inner})) WHERE rn = 1"


_IMG = f"""SELECT {token_sql("image_id")} AS image_id, {token_sql("category")} AS category, {token_sql("condition")} AS condition, {blank_sql("defect_type")} AS defect_type,
  {token_sql("nine_grid_location")} AS nine_grid_location, {token_sql("visual_severity")} AS visual_severity, anomaly_area_pixels, anomaly_area_ratio,
  CASE WHEN regexp_full_match({id_sql("sha256")}, '[0-9a-f]{{64}}') AND {id_sql("sha256")} <> repeat('0', 64) THEN {id_sql("sha256")} END AS sha256,
  {token_sql("source_split")} AS source_split, replace(image_path, '\\', '/') AS image_path, width, height, ingested_at, annotation_row FROM images WHERE {token_sql("image_id")} IS NOT NULL"""

_REC = f"""SELECT {id_sql("instruction_id")} AS instruction_id, delivered_at, {token_sql("image_id")} AS image_id, {split_sql("dataset_split")} AS split, {token_sql("task_family")} AS task_family,
  {token_sql("template_id")} AS template_id,
  list_filter(list_filter(messages, lambda m: m.role = 'user')[1].content, lambda p: p.type = 'text')[1].text AS prompt,
  list_filter(list_filter(messages, lambda m: m.role = 'assistant')[1].content, lambda p: p.type = 'text')[1].text AS answer,
  list_filter(list_filter(messages, lambda m: m.role = 'user')[1].content, lambda p: p.type = 'image')[1].image AS image,
  {token_sql("metadata.source")} AS source, {token_sql("metadata.category")} AS category, {token_sql("metadata.condition")} AS condition, {blank_sql("metadata.defect_type")} AS defect_type,
  {token_sql("metadata.location")} AS location, {token_sql("metadata.visual_severity")} AS visual_severity, {token_sql("metadata.answer_format")} AS answer_format, delivery_id
FROM instructions WHERE {id_sql("instruction_id")} IS NOT NULL"""

_PRED = f"""SELECT run_id, {id_sql("instruction_id")} AS instruction_id, generated_at_utc, {token_sql("image_id")} AS image_id, {token_sql("task_family")} AS task_family, {token_sql("category")} AS category,
  {token_sql("condition")} AS condition, {blank_sql("defect_type")} AS defect_type, {token_sql("location")} AS location, {token_sql("visual_severity")} AS visual_severity, prediction, error, generated_token_count, prediction_no
FROM predictions WHERE {id_sql("instruction_id")} IS NOT NULL AND run_id IS NOT NULL"""

VIEWS = {
    "img": _last(_IMG, "image_id", "ingested_at, coalesce(annotation_row, 2147483647), coalesce(sha256, '~'), coalesce(defect_type, '~')"),
    "rec": _last(_REC, "instruction_id", "delivered_at DESC NULLS LAST, delivery_id DESC NULLS LAST"),
    "pred": _last(_PRED, "run_id, instruction_id", "generated_at_utc DESC NULLS LAST, prediction_no DESC NULLS LAST"),
    "doc": f"SELECT * REPLACE ({token_sql('source')} AS source, {token_sql('lang')} AS lang) FROM documents",
    "pix": """SELECT image_id, i % 8 AS x, i // 8 AS y, CASE WHEN e > 0.1 THEN CASE WHEN e > 0.2 THEN 2 ELSE 1 END ELSE 0 END AS v
      FROM (SELECT vec_id AS image_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
}


def with_views(body: str, **more: str) -> str:
    """``body`` behind those views that it, or another view, names."""
    import re

    parts, used = VIEWS | more, []
    for name, text in reversed(list(parts.items())):
        if re.search(rf"\b{name}\b", body + " ".join(t for _, t in used)):
            used.insert(0, (name, text))
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in used) + "\n" + body if used else body
