"""Readers of record logs, annotations, files and images.

JSON lines are read as text first where line numbers or the end of a file matter: every line keeps its file and its position in it.
"""

from __future__ import annotations

import csv
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions.text import strip
from sightline.operators.validate import resolve_headers
from sightline.storage import bounded_rows, cut_lineage

CORRUPT = "_corrupt_record"


def _schema(spark: SparkSession, schema: StructType | str) -> StructType:
    return spark.createDataFrame([], schema).schema


def _with_corrupt(spark: SparkSession, schema: StructType | str) -> StructType:
    return StructType([*_schema(spark, schema).fields]).add(CORRUPT, "string")


def jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Fails on the first bad line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_checked(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All lines, with the text of a bad one in _corrupt_record. Arrays and scalars are bad: a record is an object."""
    return _objects(spark, path, schema)


def _objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    lines = spark.read.text(path).filter(strip("value") != "")
    parsed = F.from_json(F.when(strip("value").startswith("{"), F.col("value")), _with_corrupt(spark, schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = lines.select(F.col("value"), parsed.alias("r"))
    bad = F.when(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull(), F.col("value"))
    return out.select(*(F.col(f"r.{f.name}").alias(f.name) for f in _schema(spark, schema).fields), bad.alias(CORRUPT))


def jsonl_permissive(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, errors with a message). A missing path is one error row, not an exception."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema), spark.createDataFrame([(None, f"no such file: {path}")], "line string, message string")
    rows = _objects(spark, path, schema)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), F.lit("invalid record").alias("message"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): all lines with the block of the file that a task read them from, and their order in it."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    return lines.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))


def _running(rows: DataFrame, value: Column, out: str, including: bool) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the file's lines up to the line, or before it. Blocks are summed first, so a task sees one block at most, never a file."""
    marked = rows.withColumn("__v", value.cast("bigint"))
    before = F.sum("__v").over(Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow if including else -1))
    sums = marked.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.sum("__v").alias("__n"))
    upto = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = sums.select("__file", "__block", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    return marked.withColumn(out, F.coalesce(before, F.lit(0))).join(starts, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).withColumn(out, F.col(out) + F.col("__start")).drop("__v", "__file", "__block", "__start")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_number, value) of non-blank lines; blank ones count in the numbers. Files are split as Spark splits them."""
    lines = _running(_blocks(spark, path), F.lit(1), "row_number", True)
    return lines.filter(strip("value") != "").select("file", "row_number", "value")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_number, value) of the records of CSV files; a record goes on while a quote is open, so it may hold line breaks. Blank lines between records don't count.

    Whether a line begins within quotes follows from the number of quotes before it in its file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = _running(_blocks(spark, path), quotes, "quotes", False).withColumn("inside", F.col("quotes") % 2 == 1)
    lines = lines.filter(F.col("inside") | (strip("value") != ""))
    rows = cut_lineage(_running(lines, (~F.col("inside")).cast("int"), "row_number", True).select("file", "row_number", "block", "place", "value", "inside"), "csv-lines")
    broken = rows.filter("inside").select("file", "row_number").distinct()  # few records hold line breaks
    whole = rows.join(broken, ["file", "row_number"], "left_anti").select("file", "row_number", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = rows.join(broken, ["file", "row_number"], "left_semi").groupBy("file", "row_number").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined)


def jsonl_torn_tail(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of logs whose last line may be torn; a bad line elsewhere raises."""
    last = Window.partitionBy("file").orderBy(F.desc("row_number"))
    lines = numbered_lines(spark, path).withColumn("from_end", F.row_number().over(last))
    ok = _with_corrupt(spark, schema)
    rows = lines.withColumn("r", F.from_json("value", ok, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    message = F.concat(F.lit("bad line "), F.col("row_number"), F.lit(" of "), F.col("file"))
    checked = rows.withColumn("keep", F.when(bad & (F.col("from_end") > 1), F.raise_error(message).cast("boolean")).otherwise(~bad))
    return checked.filter("keep").select(*(F.col(f"r.{f.name}").alias(f.name) for f in _schema(spark, schema).fields))


def unique_keys(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """The rows; raises for duplicate keys and for nulls in the key or in ``required``."""
    empty = rows.filter(" OR ".join(f"`{c}` IS NULL" for c in [key, *required])).limit(1).collect()
    if empty:
        raise ValueError(f"a row has no {[key, *required]}")
    twice = rows.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {[r[0] for r in twice]}")
    return rows


def without_split(rows: DataFrame) -> DataFrame:
    return rows.drop("dataset_split")


def only_split(rows: DataFrame, split: str) -> DataFrame:
    """The rows; raises if any has another split."""
    other = rows.filter(~F.col("dataset_split").eqNullSafe(F.lit(split))).limit(1).collect()
    if other:
        raise ValueError(f"a row is not of split {split}")
    return rows


def with_ordinal(lines: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the place among all lines by (file, row_number): counts per file first, then places within files."""
    counts = lines.groupBy("file").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "start")  # one row per file
    within = Window.partitionBy("file").orderBy("row_number")
    return lines.join(starts, "file").withColumn("ordinal", F.col("start") + F.row_number().over(within) - 1).drop("start")


def record_at(indexed: DataFrame, ordinal: int) -> DataFrame:
    """The row at an ordinal, counted from the end if negative; raises IndexError if there is none."""
    if ordinal < 0:
        ordinal += indexed.count()
    found = indexed.filter(F.col("ordinal") == ordinal)
    if found.isEmpty():
        raise IndexError(ordinal)
    return found


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rows of annotation files with canonical columns, file and row number (the header is row 1), and (file, message) of files with a bad header.

    All files are read in one scan: distinct headers, which are few, are resolved on the driver and tell each file's places of the columns.
    """
    records = csv_records(spark, path)
    names = ["object", "split", "label", "image", "mask", "defect_type"]
    headers = records.filter("row_number = 1").select("file", F.col("value").alias("header"))
    places, bad, width = [], [], 1
    for head in bounded_rows(headers.select("header").distinct(), 10_000, "annotation headers"):
        columns = next(csv.reader([head["header"]]))
        try:
            found = resolve_headers(columns)
        except ValueError as error:
            bad.append((head["header"], str(error)))
            continue
        width = max(width, len(columns))
        places.append((head["header"], [columns.index(found[n]) if n in found else None for n in names]))
    known = headers.join(F.broadcast(spark.createDataFrame(places, "header string, places array<int>")), "header").select("file", "places")  # distinct headers
    fields = ", ".join(f"c{i} string" for i in range(width))
    rows = records.filter("row_number > 1").join(known, "file").select("file", F.col("row_number").cast("int").alias("row_number"), "places", F.from_csv("value", fields, {"escape": '"'}).alias("r"))
    cells = rows.select("file", "row_number", "places", F.array(*(F.col(f"r.c{i}") for i in range(width))).alias("cells"))
    out = cells.select("file", "row_number", *(F.when(F.get("places", i).isNotNull(), F.get("cells", F.get("places", i))).alias(n) for i, n in enumerate(names)))
    wrong = headers.join(F.broadcast(spark.createDataFrame(bad, "header string, message string")), "header").select("file", "message")
    return out, [(r["file"], r["message"]) for r in bounded_rows(wrong.orderBy("file"), what="files with a bad header")]


def csv_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, data_rows)."""
    records = csv_records(spark, path)
    return records.groupBy("file").agg(F.max(F.when(F.col("row_number") == 1, F.col("value"))).alias("header"), F.count_if(F.col("row_number") > 1).alias("data_rows"))


def files(spark: SparkSession, path: str, suffixes: list[str], without_masks: bool = True) -> DataFrame:
    """(path, length, modified) of all files below ``path`` with one of the suffixes, any case; paths with a mask-like segment are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    keep: Column = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes])
    if without_masks:
        keep = keep & ~F.exists(F.split(F.lower("path"), "/"), lambda s: F.contains(s, F.lit("mask")))
    return found.filter(keep)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files of any size: each is read in pieces where its task runs."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import re

        from pyarrow import fs

        def of(uri: str) -> str:
            system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            h = hashlib.sha256()
            with system.open_input_stream(place) as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
            return h.hexdigest()

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(map(of, b.column("path").to_pylist()), pa.string())], names=["path", "sha256"])

    return names.mapInArrow(digest, "path string, sha256 string")


def image_size(content: bytes) -> tuple[int, int, str] | None:
    """Width, height and format of a PNG or JPEG from its headers; None if unreadable."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        return (*struct.unpack(">II", content[16:24]), "PNG")
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height, "JPEG"
        if marker == 0xFF:
            at += 1
            continue
        at += 2 if marker in range(0xD0, 0xDA) or marker == 1 else 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, format, error) of image files."""
    return image_sizes_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def image_sizes_of(blobs: DataFrame) -> DataFrame:
    """(path, width, height, format, error) of images, ``blobs``: path, content; headers are parsed in Arrow batches."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [image_size(c or b"") for c in b.column("content").to_pylist()]
            columns = [[f and f[i] for f in found] for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array([None if f else "unreadable image" for f in found], pa.string())], names=["path", "width", "height", "format", "error"])

    return blobs.mapInArrow(parse, "path string, width int, height int, format string, error string")
