"""Queries over readers, sinks and streams: tables are written in a format and read back by the operator named."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sightline.plans.catalog import query
from sightline.plans.more import _EVENT, _log
from sightline.plans.views import images, records, table
from sightline.sources import readers, sinks
from sightline.storage import cut_lineage, scratch_path
from sightline.streaming.resume import run_once


@query("SELECT event_id, event_type, value FROM events")
def src_jsonl_object(spark, d):
    return readers.jsonl_checked(spark, _log(spark, d, "object"), _EVENT).filter(F.col(readers.CORRUPT).isNull()).drop(readers.CORRUPT)


@query("SELECT event_id, event_type, value FROM events")
def src_jsonl_torn_tail(spark, d):
    return readers.jsonl_torn_tail(spark, _log(spark, d, "tail"), _EVENT)


@query("SELECT event_id, event_type, value FROM events")
def strm_torn_write(spark, d):
    """A log to which a torn line was appended as a file of its own."""
    path = _log(spark, d, "torn")
    spark.createDataFrame([('{"event_id": 1, "event_ty',)], "value string").write.mode("append").text(path)
    return readers.jsonl_torn_tail(spark, path, _EVENT)


@query("SELECT instruction_id, task_family FROM rec")
def src_split_reader(spark, d):
    return readers.without_split(records(spark, d).select("instruction_id", "task_family", F.col("split").alias("dataset_split")))


@query("SELECT instruction_id, split AS dataset_split FROM rec WHERE split = 'test'")
def src_test_reader(spark, d):
    rows = records(spark, d).filter("split = 'test'").select("instruction_id", F.col("split").alias("dataset_split"))
    return readers.only_split(cut_lineage(rows, "test"), "test")


@query("SELECT count(*) AS lines, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS ordinals FROM events")
def src_lazy_offset_index(spark, d):
    lines = readers.with_ordinal(readers.numbered_lines(spark, _log(spark, d, "indexed")))
    return lines.agg(F.count("*").alias("lines"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("ordinal").alias("ordinals"))


def _annotation_files(spark, d) -> str:
    path = scratch_path(spark, "annotations")
    rows = images(spark, d).select(F.col("category").alias("object"), F.col("source_split").alias("set"), F.coalesce("defect_type", "condition").alias("label"), F.col("image_id").alias("image"), F.lit("").alias("mask"))
    rows.write.option("header", "true").option("emptyValue", "").csv(path)
    return path


@query("SELECT image_id AS image, category AS object, source_split AS split, coalesce(defect_type, condition) AS label FROM img")
def src_csv_annotations(spark, d):
    return readers.annotations(spark, _annotation_files(spark, d))[0].select("image", "object", "split", "label")


@query("SELECT CAST(count(*) AS BIGINT) AS data_rows, 'object,set,label,image,mask' AS header FROM img")
def src_csv_inventory(spark, d):
    return readers.csv_inventory(spark, _annotation_files(spark, d)).groupBy("header").agg(F.sum("data_rows").alias("data_rows"))


@query()
def src_dir_walk(spark, d):
    return readers.files(spark, d, [".parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("""SELECT image_id, CASE WHEN known THEN width END AS width, CASE WHEN known THEN height END AS height, CASE WHEN known THEN kind END AS format, CASE WHEN NOT known THEN 'unreadable image' END AS error
  FROM (SELECT *, width IS NOT NULL AND height IS NOT NULL AS known, CASE WHEN lower(image_path) LIKE '%.png' THEN 'PNG' ELSE 'JPEG' END AS kind FROM img)""")
def src_image_size(spark, d):
    """The headers of PNG and JPEG files with the sizes of all images, made here as the tables hold no files, and read by the parser."""
    hexed = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed("width", 8), hexed("height", 8), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000046162FFC0000B08"), hexed("height", 4), hexed("width", 4), F.lit("01000000"))
    rows = images(spark, d, "image_id", "image_path", "width", "height")
    made = rows.select(F.col("image_id").alias("path"), F.unhex(F.when(F.lower("image_path").endswith(".png"), png).otherwise(jpeg)).alias("content"))
    return readers.image_sizes_of(made).withColumnRenamed("path", "image_id")


@query("SELECT instruction_id, location FROM rec")
def snk_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    sinks.jsonl(records(spark, d).select("instruction_id", "location"), path)
    return spark.read.schema("instruction_id string, location string").json(path)


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def snk_append_log(spark, d):
    path = scratch_path(spark, "log")
    rows = table(spark, d, "events").select("event_id", "event_type")
    for _ in range(2):
        sinks.append_log(rows, path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT image_id, coalesce(defect_type, '') AS defect_type FROM img")
def snk_csv_assignments(spark, d):
    path = scratch_path(spark, "assignments")
    sinks.csv_assignments(images(spark, d), path, ["image_id", "defect_type"], "image_id")
    return spark.read.schema("image_id string, defect_type string").option("header", "true").option("nullValue", "\u0000").csv(path).select("image_id", F.coalesce("defect_type", F.lit("")).alias("defect_type"))


@query("SELECT image_id, category, CAST(NULL AS VARCHAR) AS task_family FROM img UNION ALL SELECT image_id, CAST(NULL AS VARCHAR), task_family FROM rec")
def snk_csv_union_columns(spark, d):
    return sinks.union_columns([images(spark, d).select("image_id", "category"), records(spark, d).select("image_id", "task_family")])


@query("SELECT event_id, CASE WHEN value > 200 THEN 'too high' END AS error, (SELECT count(*) > 0 FROM events WHERE value > 200) AS stopped FROM events")
def strm_error_budget(spark, d):
    """A run that has no errors to spend stops at the first batch with one; a second run without a budget does the rest."""
    source, log, state = (scratch_path(spark, x) for x in ("work", "log", "state"))
    work = table(spark, d, "events").select("event_id", "value")
    work.write.parquet(source)
    check = lambda df: df.select("event_id", F.when(F.col("value") > 200, "too high").alias("error"))
    try:
        run_once(spark, source, work.schema, log, state, "event_id", check, max_errors=0)
        stopped = False
    except StreamingQueryException:
        stopped = True
    run_once(spark, source, work.schema, log, state, "event_id", check)
    return spark.read.parquet(log).withColumn("stopped", F.lit(stopped))
