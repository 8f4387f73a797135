"""All queries of the core by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import answers, geometry, hashing, parsers, text
from sightline.functions import vocabulary as V
from sightline.operators import aggregates as A
from sightline.operators import evaluation as E
from sightline.operators import joins as J
from sightline.operators import metrics as M
from sightline.operators import sampling as S
from sightline.operators import validate as C
from sightline.plans import evaluation_sql as X
from sightline.plans import parser_sql as P
from sightline.plans import views
from sightline.plans.views import documents, images, pixels, predictions, records, table, with_views
from sightline.storage import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "met_classification"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None, **ctes: str):
    """Registers the function under its name, and its SQL behind the views it uses."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, **ctes)
        return f

    return add


def _strings(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# 2.9 scalar functions


@query(rf"""SELECT DISTINCT category AS raw, {P.name("category")} AS name, translate(lower(category), ' -', '__') AS token, {P.label("category")} AS label, {P.text("category")} AS text FROM images""")
def fn_norm_name(spark, d):
    return table(spark, d, "images").select(F.col("category").alias("raw"), text.norm_name("category").alias("name"), text.norm_token("category").alias("token"), text.norm_label("category").alias("label"), text.norm_text("category").alias("text")).distinct()


@query(f"""SELECT doc_id, sha256({P.text("text")}) AS text_digest, sha256({P.label("text")}) AS label_digest,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""")
def fn_norm_text(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(text.norm_text("text"), 256).alias("text_digest"), F.sha2(text.norm_label("text"), 256).alias("label_digest"), text.word_count("text").alias("words"))


@query(f"""SELECT DISTINCT defect_type AS raw, array_to_string({P.atoms("defect_type")}, '+') AS atoms, array_to_string({P.canonical(P.atoms("defect_type"))}, '+') AS canonical,
  array_to_string(list_filter(list_transform(string_split(coalesce(defect_type, ''), ','), lambda x: lower(trim(regexp_replace(replace(x, '_', ' '), '\\s+', ' ', 'g')))), lambda x: x <> ''), ', ') AS meta,
  coalesce(replace(replace(defect_type, '_', ' '), ',', ', '), 'not applicable') AS human FROM pred""")
def fn_split_compound(spark, d):
    atoms = text.split_compound("defect_type")
    t = predictions(spark, d)
    return t.select(F.col("defect_type").alias("raw"), F.array_join(atoms, "+").alias("atoms"), F.array_join(parsers.canonical_atoms(atoms), "+").alias("canonical"), text.norm_meta("defect_type").alias("meta"), text.humanize("defect_type").alias("human")).distinct()


@query(f"""SELECT prediction_no, contains('_' || {P.label("prediction")} || '_', '_' || {P.label("category")} || '_') AND {P.label("category")} <> '' AS named FROM pred WHERE prediction IS NOT NULL AND category IS NOT NULL""")
def fn_contains_phrase(spark, d):
    return predictions(spark, d).filter("prediction IS NOT NULL AND category IS NOT NULL").select("prediction_no", text.contains_phrase("prediction", "category").alias("named"))


@query("SELECT array_to_string(list_sort(list_distinct(flatten(list(" + P.atoms("defect_type") + ")))), ',') AS vocabulary FROM pred")
def fn_vocab_atoms(spark, d):
    return parsers.vocabulary_atoms(predictions(spark, d), "defect_type").select(F.array_join("vocabulary", ",").alias("vocabulary"))


@query("""SELECT instruction_id, sha256('42|' || coalesce(task_family, '') || '|' || instruction_id) AS stable_key, sha256('42:' || instruction_id) AS tie_breaker,
  CAST(('0x' || substr(sha256('42:' || instruction_id), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0 AS u FROM rec""")
def fn_stable_key(spark, d):
    return records(spark, d).select("instruction_id", hashing.stable_key(F.lit(SEED), "task_family", "instruction_id").alias("stable_key"), hashing.tie_breaker(F.lit(SEED), "instruction_id").alias("tie_breaker"), hashing.uniform(F.lit(SEED), "instruction_id").alias("u"))


_OBJ = f"SELECT prediction_no, run_id, instruction_id, task_family, category, condition, defect_type, location, visual_severity, prediction, {P.json_object('prediction')} AS obj FROM pred WHERE prediction IS NOT NULL"


def _said(spark, d, *columns: str):
    """The rows that hold a prediction, with just these columns and it."""
    return predictions(spark, d, "prediction", *columns).filter("prediction IS NOT NULL")


def _parsed(spark, d, what: str, *columns: str, task: str | None = None):
    rows = _said(spark, d, *columns, *(["task_family"] if task else []))
    return parsers.parse(rows.filter(F.col("task_family") == task) if task else rows, "prediction", [what])


@query("SELECT prediction_no, obj IS NOT NULL AS is_object, array_to_string(list_sort(json_keys(obj)), ',') AS keys FROM said", said=_OBJ)
def fn_parse_json_loose(spark, d):
    return _parsed(spark, d, "obj", "prediction_no").select("prediction_no", F.col("obj").isNotNull().alias("is_object"), F.array_join(F.array_sort(F.json_object_keys("obj")), ",").alias("keys"))


@query(f"SELECT prediction_no, {P.condition('prediction', 'obj')} AS said FROM said", said=_OBJ)
def fn_parse_condition(spark, d):
    return _parsed(spark, d, "said_condition", "prediction_no").select("prediction_no", F.col("said_condition").alias("said"))


@query(f"SELECT prediction_no, {P.product('prediction', 'obj')} AS said FROM said", said=_OBJ)
def fn_parse_product(spark, d):
    return _parsed(spark, d, "said_product", "prediction_no").select("prediction_no", F.col("said_product").alias("said"))


@query(f"SELECT prediction_no, {P.location('prediction', 'obj')} AS said FROM said", said=_OBJ)
def fn_parse_location(spark, d):
    return _parsed(spark, d, "said_location", "prediction_no").select("prediction_no", F.col("said_location").alias("said"))


@query(f"SELECT prediction_no, {P.severity('prediction', 'obj')} AS said FROM said", said=_OBJ)
def fn_parse_severity(spark, d):
    return _parsed(spark, d, "said_severity", "prediction_no").select("prediction_no", F.col("said_severity").alias("said"))


@query("SELECT prediction_no, " + ", ".join(f"{v} AS {k}" for k, v in P.uncertainty("prediction").items()) + " FROM said", said=_OBJ)
def fn_parse_uncertainty(spark, d):
    return parsers.parse(_said(spark, d, "prediction_no"), "prediction", list(parsers.UNCERTAINTY)).select("prediction_no", *parsers.UNCERTAINTY)


_VOC = "SELECT list_sort(list_distinct(flatten(list(" + P.atoms("defect_type") + ")))) AS words FROM pred"


@query(f"SELECT prediction_no, array_to_string({P.defects('prediction', 'obj', 'words')}, '+') AS said FROM said, voc", said=_OBJ, voc=_VOC)
def fn_parse_defects(spark, d):
    rows = _said(spark, d, "prediction_no")
    words = parsers.vocabulary_atoms(predictions(spark, d, "defect_type", "run_id", "instruction_id"), "defect_type")
    rows = parsers.parse(rows.join(F.broadcast(words)), "prediction", ["said_defects"], "vocabulary")  # words: one row
    return rows.select("prediction_no", F.array_join("said_defects", "+").alias("said"))


@query(f"SELECT prediction_no, array_to_string({P.semantic('prediction', 'obj', 'words')}, '+') AS said FROM said, voc", said=_OBJ, voc=_VOC)
def fn_parse_defects_semantic(spark, d):
    rows = _said(spark, d, "prediction_no")
    words = parsers.vocabulary_atoms(predictions(spark, d, "defect_type", "run_id", "instruction_id"), "defect_type")
    rows = parsers.parse(rows.join(F.broadcast(words)), "prediction", ["said_semantic"], "vocabulary")  # words: one row
    return rows.select("prediction_no", F.array_join("said_semantic", "+").alias("said"))


_FEATURES = """SELECT image_id, count(*) AS area, count(*) / 64.0::DOUBLE AS ratio, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max, avg(x) AS cx, avg(y) AS cy FROM pix WHERE v > 0 GROUP BY image_id"""


def _features(spark, d):
    p = pixels(spark, d)
    return geometry.mask_features(p, p.select("image_id").distinct().withColumns({"width": F.lit(8), "height": F.lit(8)}))


@query("SELECT image_id, area, ratio, x_min, y_min, x_max, y_max, x_max - x_min + 1 AS box_width, y_max - y_min + 1 AS box_height, (x_max + 1) / 8.0::DOUBLE AS x_max_normalized FROM f", f=_FEATURES)
def fn_bbox(spark, d):
    return _features(spark, d).select("image_id", "area", "ratio", *(F.col(c).cast("bigint").alias(c) for c in ("x_min", "y_min", "x_max", "y_max", "box_width", "box_height")), "x_max_normalized")


@query(f"""SELECT image_id, round(cx, 9) AS x, round(cy, 9) AS y, round(cx / 8, 9) AS x_normalized,
  {V.LOCATIONS!r}[CAST(least(floor(cy / 8 * 3), 2) * 3 + least(floor(cx / 8 * 3), 2) AS INT) + 1] AS cell FROM f""", f=_FEATURES)
def fn_centroid(spark, d):
    f = _features(spark, d)
    return f.select("image_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("x_normalized", 9).alias("x_normalized"), geometry.nine_grid("x_normalized", "y_normalized").alias("cell"))


_KEYWORD = "(" + " OR ".join(f"contains(replace(lower(coalesce(defect_type, '')), '_', ' '), '{k}')" for k in V.MAJOR_KEYWORDS) + ")"


@query(f"""SELECT image_id, CASE WHEN {_KEYWORD} THEN 'major' WHEN anomaly_area_ratio < {V.MINOR_BELOW} THEN 'minor' WHEN anomaly_area_ratio < {V.MODERATE_BELOW} THEN 'moderate' ELSE 'major' END AS severity,
  CASE WHEN {_KEYWORD} THEN 'defect_keyword_override' ELSE 'area_ratio' END AS basis FROM img WHERE condition = 'anomalous'""")
def fn_severity(spark, d):
    return images(spark, d).filter("condition = 'anomalous'").select("image_id", geometry.severity("anomaly_area_ratio", "defect_type").alias("severity"), geometry.severity_basis("defect_type").alias("basis"))


@query("""SELECT image_id, v, n FROM (SELECT image_id, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS foreground_pixels FROM pix GROUP BY image_id) h
  JOIN (SELECT image_id, v, count(*) AS n FROM pix GROUP BY image_id, v) USING (image_id) WHERE foreground_pixels > 0""")
def src_mask_histogram(spark, d):
    p = pixels(spark, d)
    seen = geometry.mask_histogram(p).filter("foreground_pixels > 0").select("image_id")
    return p.groupBy("image_id", F.col("v").alias("v")).agg(F.count("*").alias("n")).join(seen, "image_id")


@query("""SELECT count(*) AS masks, count(*) FILTER (u = 1) AS binary_masks, count(*) FILTER (u > 1) AS multi_masks
  FROM (SELECT image_id, count(DISTINCT v) FILTER (v > 0) AS u FROM pix GROUP BY image_id) WHERE u > 0""")
def agg_mask_counts(spark, d):
    h = geometry.mask_histogram(pixels(spark, d)).filter("foreground_pixels > 0")
    return h.agg(F.count("*").alias("masks"), F.count_if("is_binary").alias("binary_masks"), F.count_if(~F.col("is_binary")).alias("multi_masks"))


_STEPS = "SELECT run_id AS location, 'checkpoint-' || CAST(max_sequence_length / 8 AS BIGINT) || '-' || CAST(row_number() OVER (ORDER BY run_id) AS BIGINT) AS name FROM train_runs"


@query(r"SELECT DISTINCT template_id, CAST(coalesce(nullif(regexp_extract(template_id, '_([0-9]+)$', 1), ''), '-1') AS BIGINT) AS step FROM rec")
def fn_checkpoint_step(spark, d):
    return records(spark, d).select("template_id", F.coalesce(F.nullif(F.regexp_extract("template_id", "_([0-9]+)$", 1), F.lit("")), F.lit("-1")).cast("bigint").alias("step")).distinct()


# 2.3 projections and validation


@query(f"""SELECT DISTINCT defect_type AS label, CASE WHEN {P.name("coalesce(defect_type, '')")} IN ('normal','good','0','false') THEN 'normal' WHEN {P.name("coalesce(defect_type, '')")} NOT IN ('none','null','na','nan','') THEN 'anomalous' END AS condition,
  CASE WHEN {P.name("coalesce(defect_type, '')")} NOT IN ('normal','good','0','false','none','null','na','nan','') THEN array_to_string(list_filter(list_transform(string_split(defect_type, ','), lambda a: {P.name("a")}), lambda a: a <> ''), ',') END AS defects FROM images""")
def prj_parse_label(spark, d):
    p = C.parse_label("label")
    return table(spark, d, "images").select(F.col("defect_type").alias("label")).distinct().select("label", p["condition"].alias("condition"), p["defect_type"].alias("defects"))


@query(r"""SELECT image_id, CASE WHEN len(list_intersect(t, ['normal','good'])) > 0 THEN 'normal' WHEN len(list_intersect(t, ['anomaly','anomalous','defect','defective','bad'])) > 0 THEN 'anomalous' END AS condition,
  list_filter(t, lambda x: x IN %s)[1] AS category, regexp_replace(replace(image_path, '/Images/', '/Masks/'), '\.[^./]*$', '.png') AS mask
  FROM (SELECT image_id, image_path, list_transform(list_filter(string_split(image_path, '/'), lambda x: x <> ''), lambda x: translate(lower(x), ' -', '__')) AS t FROM img)""" % _strings(V.CATEGORIES))
def prj_infer_condition(spark, d):
    return images(spark, d).select("image_id", C.infer_condition("image_path").alias("condition"), C.find_category("image_path").alias("category"), C.candidate_mask("image_path").alias("mask"))


@query(r"SELECT DISTINCT image, nullif(regexp_extract(replace(image, '\', '/'), '(?i)(?:^|/)(data/raw/visa(?:/.*)?)$', 1), '') AS suffix, NOT (replace(image, '\', '/') LIKE '/%' OR contains(image, '..')) AS contained FROM rec WHERE image IS NOT NULL")
def prj_path_containment(spark, d):
    return records(spark, d).filter("image IS NOT NULL").select("image", C.path_suffix("image").alias("suffix"), C.path_contained("image").alias("contained")).distinct()


@query("SELECT instruction_id, sha256(coalesce(prompt, '')) AS prompt, sha256(coalesce(answer, '')) AS answer, image FROM rec")
def prj_message_access(spark, d):
    return records(spark, d).select("instruction_id", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt"), F.sha2(F.coalesce("answer", F.lit("")), 256).alias("answer"), "image")


_ANSWERED = f"SELECT *, {P.json_object('answer')} AS obj, {P.strip_sql('answer')} AS t FROM rec WHERE answer IS NOT NULL AND answer_format = 'json'"


@query(f"""SELECT instruction_id, CASE WHEN obj IS NULL OR NOT (t LIKE '{{%' AND t LIKE '%}}') THEN 'invalid_json' ELSE array_to_string(list_filter([{", ".join(f"CASE WHEN NOT {P.has('obj', k)} THEN 'missing:{k}' END" for k in sorted(V.REPORT_KEYS))}], lambda x: x IS NOT NULL), ',') END AS problems FROM a""", a=_ANSWERED)
def prj_json_answer_valid(spark, d):
    return records(spark, d).filter("answer IS NOT NULL AND answer_format = 'json'").select("instruction_id", F.array_join(C.report_key_problems("answer", "answer_format"), ",").alias("problems"))


@query(f"""SELECT instruction_id, coalesce({P.field("obj", "product")} = category, false) AS product, coalesce({P.field("obj", "condition")} = CASE WHEN condition = 'anomalous' THEN 'defective' ELSE 'normal' END, false) AS condition,
  coalesce({P.field("obj", "visual_severity")} = visual_severity, false) AS severity, coalesce(replace({P.field("obj", "location")}, '_', ' '), '-') = coalesce(replace(location, '_', ' '), '-') AS location FROM a WHERE obj IS NOT NULL""", a=_ANSWERED)
def prj_json_metadata_match(spark, d):
    rows = parsers.with_parts(records(spark, d).filter("answer IS NOT NULL AND answer_format = 'json'"), "answer").filter("obj IS NOT NULL")
    f = lambda k: F.col(f"__s_{k}")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    plain = lambda c: F.coalesce(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("-"))
    return rows.select("instruction_id", same(f("product"), F.col("category")).alias("product"), same(f("condition"), F.when(F.col("condition") == "anomalous", "defective").otherwise("normal")).alias("condition"), same(f("visual_severity"), F.col("visual_severity")).alias("severity"), (plain(f("location")) == plain(F.col("location"))).alias("location"))


@query("SELECT delivery_id, array_to_string(list_filter(%s, lambda m: contains(lower(coalesce(answer, '')), m)), ',') AS markers FROM rec" % sorted(V.PRIVILEGED_MARKERS))
def prj_privileged_marker(spark, d):
    return records(spark, d).select("delivery_id", F.array_join(C.privileged_markers("answer"), ",").alias("markers"))


_FIRST_SPLIT = f"""SELECT instruction_id, split AS expected FROM (SELECT *, row_number() OVER (PARTITION BY instruction_id ORDER BY delivered_at, delivery_id) AS rn
  FROM (SELECT {views.id_sql("instruction_id")} AS instruction_id, {views.split_sql("dataset_split")} AS split, delivered_at, delivery_id FROM instructions) WHERE split IS NOT NULL AND instruction_id IS NOT NULL) WHERE rn = 1"""
_MISSING_KEYS = ", ".join(f"CASE WHEN NOT {P.has('obj', k)} THEN 'missing:{k}' END" for k in sorted(V.REPORT_KEYS))
_PROBLEMS = f"""SELECT instruction_id, task_family, unnest(list_filter(list_concat([
    CASE WHEN split IS DISTINCT FROM expected THEN 'wrong split' END, CASE WHEN NOT coalesce(list_contains({V.TASKS!r}, task_family), false) THEN 'unsupported task' END,
    CASE WHEN {views.strip_sql("coalesce(prompt, '')")} = '' THEN 'empty prompt' END, CASE WHEN {views.strip_sql("coalesce(answer, '')")} = '' THEN 'empty answer' END],
    list_transform(list_filter({sorted(V.PRIVILEGED_MARKERS)!r}, lambda m: contains(lower(coalesce(answer, '')), m)), lambda m: 'marker:' || m),
    CASE WHEN answer_format <> 'json' THEN CAST([] AS VARCHAR[]) WHEN obj IS NULL OR NOT (t LIKE '{{%' AND t LIKE '%}}') THEN ['invalid_json'] ELSE [{_MISSING_KEYS}] END,
    CASE WHEN known IS NULL THEN ['image not found'] WHEN NOT coalesce(width > 0 AND height > 0, false) THEN ['image is empty'] ELSE CAST([] AS VARCHAR[]) END), lambda x: x IS NOT NULL)) AS problem FROM checked"""
_CHECKED = f"""SELECT r.*, e.expected, i.known, i.width, i.height, CASE WHEN answer_format = 'json' THEN {P.json_object("answer")} END AS obj, {views.strip_sql("answer")} AS t
  FROM rec r LEFT JOIN expected e USING (instruction_id) LEFT JOIN (SELECT image_id, width, height, true AS known FROM img) i ON r.image_id = i.image_id"""
_PROBLEM_VIEWS = {"expected": _FIRST_SPLIT, "checked": _CHECKED, "problems": _PROBLEMS}


def _record_problems(spark, d):
    """(instruction_id, task_family, problem) of all records. A record's expected split is the one under which it was delivered first."""
    rows = records(spark, d, "instruction_id", "image_id", "split", "task_family", "prompt", "answer", "answer_format")
    split = text.canonical_split("dataset_split")
    first = table(spark, d, "instructions").select(text.canonical_id("instruction_id").alias("instruction_id"), split.alias("split"), "delivered_at", "delivery_id").filter("split IS NOT NULL AND instruction_id IS NOT NULL")
    first = first.groupBy("instruction_id").agg(F.min_by("split", F.struct("delivered_at", "delivery_id")).alias("expected"))
    pictures = images(spark, d, "image_id", "width", "height").withColumn("known", F.lit(True))
    both = rows.join(first, "instruction_id", "left").join(pictures, "image_id", "left")
    image = F.when(F.col("known").isNull(), F.array(F.lit("image not found"))).when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), F.array(F.lit("image is empty"))).otherwise(F.array().cast("array<string>"))
    problems = C.record_problems("split", "expected", "task_family", "prompt", "answer", "answer_format")
    return both.select("instruction_id", "task_family", F.explode(F.concat(problems, image)).alias("problem"))


@query("SELECT instruction_id, problem FROM problems", **_PROBLEM_VIEWS)
def prj_record_validate(spark, d):
    return _record_problems(spark, d).select("instruction_id", "problem")


@query("""SELECT r.delivery_id, CASE WHEN r.delivery_id > m.first_id THEN 'instruction_id' END AS duplicate_of FROM (SELECT delivery_id, %s AS k FROM instructions) r
  LEFT JOIN (SELECT %s AS k, min(delivery_id) AS first_id FROM instructions GROUP BY 1) m ON r.k = m.k""" % (views.id_sql("instruction_id"), views.id_sql("instruction_id")))
def prj_first_wins_dedup(spark, d):
    rows = table(spark, d, "instructions").select("delivery_id", text.canonical_id("instruction_id").alias("instruction_id"))
    return C.first_wins(rows, ["instruction_id"], ["delivery_id"]).select("delivery_id", "duplicate_of")


def _norm(x: str) -> str:
    return P.name(f"coalesce({x}, '')")


def _clean(x: str) -> str:
    return rf"CASE WHEN {x} IS NOT NULL AND {_norm(x)} NOT IN {_strings(C.NULL_WORDS)} THEN regexp_replace(replace({x}, '\', '/'), '^[./]+', '') END"


_ROWS = f"""SELECT annotation_path AS file, annotation_row AS row_number, {views.token_sql("category")} AS folder, category AS object, source_split AS split, coalesce(defect_type, condition) AS label, {_clean("image_path")} AS image, {_clean("mask_path")} AS mask,
  CASE WHEN {_norm("coalesce(defect_type, condition)")} IN {_strings(C.NORMAL_LABELS)} THEN 'normal' WHEN {_norm("coalesce(defect_type, condition)")} NOT IN {_strings(C.NULL_WORDS)} THEN 'anomalous' END AS condition,
  array_to_string(list_filter(list_transform(string_split(coalesce(defect_type, condition), ','), lambda a: {P.name("a")}), lambda a: a <> ''), ',') AS atoms, coalesce(nullif({_norm("category")}, ''), {P.name(views.token_sql("category"))}) AS chosen FROM images"""
_RECORDS = rf"""SELECT file, row_number, concat_ws('_', 'visa', chosen, condition, regexp_replace(regexp_extract(image, '([^/]*)$', 1), '\.[^.]*$', '')) AS image_id, chosen AS category, condition, CASE WHEN condition = 'anomalous' THEN atoms END AS defect_type,
  CASE WHEN {_norm("split")} IN ('train', 'training') THEN 'train' WHEN {_norm("split")} IN ('test', 'testing', 'validation', 'val') THEN 'test' ELSE 'unknown' END AS source_split, image AS image_path, mask AS mask_path,
  CASE WHEN nullif({_norm("object")}, '') IS NOT NULL AND {_norm("object")} <> {P.name("folder")} THEN 'category differs from folder' WHEN NOT coalesce(list_contains({V.CATEGORIES!r}, chosen), false) THEN 'unexpected category'
    WHEN condition IS NULL THEN 'label is empty' WHEN image IS NULL THEN 'image path is empty' WHEN condition = 'normal' AND mask IS NOT NULL THEN 'normal row has a mask' WHEN condition = 'anomalous' AND mask IS NULL THEN 'anomalous row has no mask' END AS error FROM anno"""
_RECORD_VIEWS = {"anno": _ROWS, "parsed_rows": _RECORDS}


@query("SELECT * FROM parsed_rows", **_RECORD_VIEWS)
def prj_row_to_record(spark, d):
    rows = table(spark, d, "images").select(F.col("annotation_path").alias("file"), F.col("annotation_row").alias("row_number"), text.canonical_token("category").alias("folder"), F.col("category").alias("object"), F.col("source_split").alias("split"), F.coalesce("defect_type", "condition").alias("label"), F.col("image_path").alias("image"), F.col("mask_path").alias("mask"), F.lit(None).cast("string").alias("defect_type"))
    return C.rows_to_records(rows)


# 2.5 aggregations


@query("""SELECT dim, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'category' AS dim, category AS value, count(*) AS n FROM img GROUP BY 2 UNION ALL SELECT 'condition', condition, count(*) FROM img GROUP BY 2 UNION ALL SELECT 'source_split', source_split, count(*) FROM img GROUP BY 2
  UNION ALL SELECT 'nine_grid_location', nine_grid_location, count(*) FROM img GROUP BY 2 UNION ALL SELECT 'visual_severity', visual_severity, count(*) FROM img GROUP BY 2) GROUP BY 1, 2""")
def agg_counts_1d(spark, d):
    return A.counts_1d(images(spark, d), ["category", "condition", "source_split", "nine_grid_location", "visual_severity"])


@query("SELECT category, condition, n, level FROM (SELECT category, condition, count(*) AS n, CAST(grouping(category, condition) AS BIGINT) AS level FROM img GROUP BY CUBE (category, condition)) WHERE level < 3")
def agg_counts_2d(spark, d):
    return A.counts_2d(images(spark, d), "category", "condition")


@query("""WITH s AS (SELECT unnest(['train','validation','test']) AS split), d AS (SELECT unnest(['category','condition','task_family']) AS dim),
  c AS (SELECT split, 'category' AS dim, category AS value, count(*) AS n FROM rec GROUP BY ALL UNION ALL SELECT split, 'condition', condition, count(*) FROM rec GROUP BY ALL UNION ALL SELECT split, 'task_family', task_family, count(*) FROM rec GROUP BY ALL)
  SELECT s.split, d.dim, c.value, coalesce(c.n, 0) AS n FROM s CROSS JOIN d LEFT JOIN c ON c.split = s.split AND c.dim = d.dim""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def agg_split_stats(spark, d):
    return A.split_stats(records(spark, d), "split", ["category", "condition", "task_family"], S.SPLITS)


@query("SELECT task_family, coalesce(location, 'none') AS location, coalesce(defect_type, 'none') AS defect_type, count(*) AS n FROM rec WHERE split = 'test' GROUP BY ALL")
def agg_distribution(spark, d):
    t = records(spark, d).filter("split = 'test'")
    return t.groupBy("task_family", F.coalesce("location", F.lit("none")).alias("location"), F.coalesce("defect_type", F.lit("none")).alias("defect_type")).agg(F.count("*").alias("n"))


@query("SELECT category, min(anomaly_area_ratio) AS min, max(anomaly_area_ratio) AS max, round(avg(anomaly_area_ratio), 9) AS mean, count(anomaly_area_ratio) AS n FROM img WHERE condition = 'anomalous' GROUP BY 1")
def agg_minmaxmean(spark, d):
    return A.min_max_mean(images(spark, d).filter("condition = 'anomalous'"), "anomaly_area_ratio", ["category"]).withColumn("mean", F.round("mean", 9))


_RANKS = "SELECT list_sort(list(v)) AS a, count(*) AS n, avg(v) AS mean, median(v) AS med FROM ({}) WHERE v IS NOT NULL"
_NEAREST = ", ".join(f"a[CAST(round_even((n - 1) * {p}::DOUBLE, 0) AS BIGINT) + 1] AS p{round(p * 100)}" for p in A.PERCENTS)


@query(f"SELECT n AS count, a[1] AS min, med AS median, {_NEAREST}, a[n] AS max, round(mean, 6) AS mean FROM r", r=_RANKS.format("SELECT n_chars AS v FROM documents"))
def agg_percentiles(spark, d):
    return A.percentiles(table(spark, d, "documents"), "n_chars").withColumn("mean", F.round("mean", 6))


@query(f"SELECT n AS count, a[1] AS min, med AS median, {_NEAREST}, a[n] AS max, round(mean, 6) AS mean FROM r", r=_RANKS.format("SELECT count(*) AS v FROM rec GROUP BY image_id"))
def agg_per_entity_distribution(spark, d):
    return A.percentiles(records(spark, d).groupBy("image_id").agg(F.count("*").alias("n")), "n").withColumn("mean", F.round("mean", 6))


@query("SELECT count(DISTINCT prompt) AS prompts, count(DISTINCT answer) AS answers, count(DISTINCT image_id) AS images, count(DISTINCT (prompt, template_id)) AS pairs FROM rec WHERE prompt IS NOT NULL AND template_id IS NOT NULL")
def agg_distinct(spark, d):
    r = records(spark, d).filter("prompt IS NOT NULL AND template_id IS NOT NULL")
    return r.agg(F.count_distinct("prompt").alias("prompts"), F.count_distinct("answer").alias("answers"), F.count_distinct("image_id").alias("images"), F.count_distinct(F.struct("prompt", "template_id")).alias("pairs"))


@query("""SELECT count(*) AS unique_values, count(*) FILTER (n > 1) AS repeated_values, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated, greatest(coalesce(max(n), 1), 1) AS max_frequency
  FROM (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def agg_duplicate_summary(spark, d):
    return A.duplicate_summary(table(spark, d, "documents").withColumn("t", F.sha2("text", 256)), "t")


@query("SELECT sha256(text) AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 25")
def lim_topk(spark, d):
    return A.top_repeated(table(spark, d, "documents").withColumn("t", F.sha2("text", 256)), "t")


@query("SELECT %s AS value, count(*) AS n FROM instructions WHERE %s IS NOT NULL GROUP BY 1 HAVING count(*) > 1" % (views.id_sql("instruction_id"), views.id_sql("instruction_id")))
def agg_having_dups(spark, d):
    return A.repeated(table(spark, d, "instructions").select(text.canonical_id("instruction_id").alias("i")), "i")


@query("SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM (SELECT image_id AS key, split FROM rec WHERE image_id IS NOT NULL AND split IS NOT NULL) GROUP BY key HAVING count(DISTINCT split) > 1")
def agg_image_split_leak(spark, d):
    return A.cross_split_leaks(records(spark, d), "image_id", "split")


@query("SELECT key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM (SELECT sha256 AS key, source_split AS split FROM img WHERE sha256 IS NOT NULL AND source_split IS NOT NULL) GROUP BY key HAVING count(DISTINCT split) > 1")
def agg_cross_split_leak(spark, d):
    return A.cross_split_leaks(images(spark, d), "sha256", "source_split")


@query("SELECT task_family, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions FROM rec GROUP BY 1")
def agg_collect_set(spark, d):
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return records(spark, d).groupBy("task_family").agg(joined("category").alias("categories"), joined("condition").alias("conditions"))


@query("SELECT * FROM prints", prints=X.corpus_print("rec", "split, task_family"))
def agg_fingerprint(spark, d):
    return A.corpus_fingerprint(records(spark, d, "instruction_id", "split", "task_family"), "instruction_id", ["split", "task_family"])


@query("SELECT * FROM prints", prints=X.corpus_print("rec", "split"))
def agg_corpus_fingerprint(spark, d):
    return A.corpus_fingerprint(records(spark, d, "instruction_id", "split"), "instruction_id", ["split"])


@query(f"SELECT bool_and(condition IN ('normal','anomalous')) AS known_conditions, bool_and(width > 0 AND height > 0) AS sizes, bool_or(sha256 IS NULL) AS digests_missing, bool_or(category NOT IN {_strings(V.CATEGORIES)}) AS unexpected FROM img")
def agg_bool_all(spark, d):
    i = images(spark, d)
    return i.agg(A.all_true(F.col("condition").isin("normal", "anomalous")).alias("known_conditions"), A.all_true((F.col("width") > 0) & (F.col("height") > 0)).alias("sizes"), A.any_true(F.col("sha256").isNull()).alias("digests_missing"), A.any_true(~F.col("category").isin(V.CATEGORIES)).alias("unexpected"))


_EXPECTED = "SELECT unnest(%s) AS category, 100 AS expected" % V.CATEGORIES


@query("SELECT coalesce(e.category, f.category) AS category, CAST(coalesce(e.expected, 0) AS BIGINT) AS expected, coalesce(f.n, 0) AS found FROM e FULL JOIN (SELECT category, count(*) AS n FROM img WHERE category IS NOT NULL GROUP BY 1) f ON e.category = f.category WHERE coalesce(e.expected, 0) <> coalesce(f.n, 0)", e=_EXPECTED)
def agg_expected_counts(spark, d):
    found = images(spark, d).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    expected = spark.createDataFrame([(c, 100) for c in V.CATEGORIES], "category string, n bigint")
    return A.expected_counts(found, expected, "category")


_QUOTA = "SELECT unnest(%s) AS task_family, unnest([40, 30, 30, 30, 20, 30, 15, 15]) AS quota" % V.TASKS
_QUOTAS = dict(zip(V.TASKS, [40, 30, 30, 30, 20, 30, 15, 15]))


def _quotas(spark):
    return spark.createDataFrame(list(_QUOTAS.items()), "task_family string, quota bigint")


@query("SELECT q.task_family, CAST(q.quota AS BIGINT) AS expected, coalesce(r.n, 0) AS found FROM q LEFT JOIN (SELECT task_family, count(*) AS n FROM rec WHERE split = 'test' GROUP BY 1) r USING (task_family) WHERE q.quota <> coalesce(r.n, 0)", q=_QUOTA)
def agg_task_quota_check(spark, d):
    found = records(spark, d).filter("split = 'test' AND task_family IS NOT NULL").groupBy("task_family").agg(F.count("*").alias("n")).join(_quotas(spark).select("task_family"), "task_family", "left_semi")
    return A.expected_counts(found, _quotas(spark).withColumnRenamed("quota", "n"), "task_family")


@query("SELECT split, count(*) AS n, count(DISTINCT instruction_id) AS ids, count(DISTINCT image_id) AS images, count(DISTINCT category) AS categories FROM rec GROUP BY 1")
def agg_selection_summary(spark, d):
    return records(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("instruction_id").alias("ids"), F.count_distinct("image_id").alias("images"), F.count_distinct("category").alias("categories"))


# 2.6 metrics: binary answers of all runs, parsed

_BINARY = f"SELECT run_id, category, condition AS truth, {P.condition('prediction', 'obj')} AS said FROM said WHERE task_family = 'binary_inspection' AND condition IS NOT NULL"
_CELLS = "SELECT truth, coalesce(said, '__unparsed__') AS predicted, count(*) AS n FROM bin GROUP BY 1, 2"
_LABELS = """SELECT label, CAST(coalesce(sum(n) FILTER (truth = label AND predicted = label), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (truth <> label AND predicted = label), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(n) FILTER (truth = label AND predicted <> label), 0) AS BIGINT) AS fn, CAST(coalesce(sum(n) FILTER (truth = label), 0) AS BIGINT) AS support
  FROM cells, (SELECT DISTINCT unnest([truth, predicted]) AS label FROM cells) WHERE label <> '__unparsed__' GROUP BY label"""
_PR = "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM lab"
_F1 = "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM pr"
_METRIC_VIEWS = {"said": _OBJ, "bin": _BINARY, "cells": _CELLS, "lab": _LABELS, "pr": _PR, "f1s": _F1}


def _binary(spark, d):
    rows = _parsed(spark, d, "said_condition", "run_id", "category", "condition", task="binary_inspection").filter("condition IS NOT NULL")
    return rows.select("run_id", "category", F.col("condition").alias("truth"), F.col("said_condition").alias("said"))


@query("SELECT label, tp, fp, fn, support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f1s", **_METRIC_VIEWS)
def met_classification(spark, d):
    return M.classification_by_label(_binary(spark, d), "truth", "said").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""SELECT CAST(sum(n) AS BIGINT) AS count, round(sum(n) FILTER (truth = predicted) / sum(n), 9) AS accuracy, CAST(coalesce(sum(n) FILTER (predicted = '__unparsed__'), 0) AS BIGINT) AS unparsed,
  round((SELECT avg(f1) FROM f1s), 9) AS macro_f1 FROM cells""", **_METRIC_VIEWS)
def met_classification_overall(spark, d):
    m = M.classification_overall(_binary(spark, d), "truth", "said")
    return m.select("count", F.round("accuracy", 9).alias("accuracy"), "unparsed", F.round("macro_f1", 9).alias("macro_f1"))


@query("SELECT t.truth, p.predicted, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT truth FROM cells) t CROSS JOIN (SELECT DISTINCT predicted FROM cells) p LEFT JOIN cells c ON c.truth = t.truth AND c.predicted = p.predicted", **_METRIC_VIEWS)
def met_confusion_dense(spark, d):
    return M.confusion_dense(_binary(spark, d), "truth", "said")


@query("SELECT truth, predicted, n, row_number() OVER (ORDER BY n DESC, truth, predicted) AS rank FROM cells WHERE truth <> predicted", **_METRIC_VIEWS)
def met_confusion_ranked(spark, d):
    return M.confusion_ranked(_binary(spark, d), "truth", "said")


_SETS = f"""SELECT prediction_no, category, {P.atoms("defect_type")} AS t, {P.defects("prediction", "obj", "words")} AS p FROM said, voc WHERE task_family = 'defect_identification'"""
_SET_SCORES = """SELECT prediction_no, category, len(list_intersect(t, p)) = len(t) AND len(list_intersect(t, p)) = len(p) AS exact_match,
  CASE WHEN len(t) = 0 AND len(p) = 0 THEN 1.0 ELSE coalesce(len(list_intersect(t, p)) / nullif(len(p), 0), 0) END::DOUBLE AS precision,
  CASE WHEN len(t) = 0 AND len(p) = 0 THEN 1.0 ELSE coalesce(len(list_intersect(t, p)) / nullif(len(t), 0), 0) END::DOUBLE AS recall,
  CASE WHEN len(t) = 0 AND len(p) = 0 THEN 1.0 ELSE 2 * len(list_intersect(t, p)) / (len(t) + len(p)) END::DOUBLE AS f1 FROM sets"""
_SET_VIEWS = {"said": _OBJ, "voc": _VOC, "sets": _SETS, "scored": _SET_SCORES}


def _sets(spark, d):
    p = predictions(spark, d, "prediction_no", "task_family", "category", "defect_type", "prediction")
    rows = E.parsed(p.filter("task_family = 'defect_identification'"), predictions(spark, d, "run_id", "instruction_id", "defect_type"))
    return rows.withColumns(M.set_scores("true_defects", "said_defects"))


@query("SELECT prediction_no, exact_match, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM scored", **_SET_VIEWS)
def met_set_row(spark, d):
    return _sets(spark, d).select("prediction_no", "exact_match", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT category, round(avg(exact_match::INT), 6) AS exact_match, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*)::DOUBLE AS count FROM scored GROUP BY 1", **_SET_VIEWS)
def met_set_macro(spark, d):
    return M.set_macro(_sets(spark, d), ["category"]).withColumns({c: F.round(c, 6) for c in ("exact_match", "precision", "recall", "f1")})


_PLACE = f"SELECT prediction_no, location AS truth, {P.location('prediction', 'obj')} AS said FROM said WHERE task_family = 'localization'"
_CELL = lambda c: f"(list_position({V.LOCATIONS!r}, {c}) - 1)"


@query(f"""SELECT prediction_no, truth, said, coalesce(abs({_CELL("truth")} // 3 - {_CELL("said")} // 3) <= 1 AND abs({_CELL("truth")} % 3 - {_CELL("said")} % 3) <= 1, false) AS adjacent FROM place""", said=_OBJ, place=_PLACE)
def met_adjacent(spark, d):
    rows = _parsed(spark, d, "said_location", "prediction_no", "location", task="localization").select("prediction_no", F.col("location").alias("truth"), F.col("said_location").alias("said"))
    return rows.withColumn("adjacent", M.adjacent("truth", "said"))


_EVALUATION_COLUMNS = ["prediction_no", "run_id", "instruction_id", "image_id", "task_family", "category", "condition", "defect_type", "location", "visual_severity", "prediction"]


def _evaluated(spark, d):
    """All predictions with their scores and failure tags; written once, as every report reads them more than once."""
    p = predictions(spark, d, *_EVALUATION_COLUMNS)
    return cut_lineage(E.evaluated(E.parsed(p, predictions(spark, d, "run_id", "instruction_id", "defect_type"))), "evaluated")


@query("SELECT prediction_no, task_family, array_to_string(tags, ',') AS tags, round(fact_coverage, 6) AS fact_coverage FROM ev", **X.VIEWS)
def met_eval_row(spark, d):
    return _evaluated(spark, d).select("prediction_no", "task_family", F.array_join("tags", ",").alias("tags"), F.round("fact_coverage", 6).alias("fact_coverage"))


@query("SELECT * FROM tm", **X.TASK_VIEWS)
def met_task_aggregate(spark, d):
    return E.task_metrics(_evaluated(spark, d)).withColumn("value", F.round("value", 6))


@query(X.CATEGORIES, **X.VIEWS)
def met_category_rollup(spark, d):
    return E.category_rollup(_evaluated(spark, d)).withColumns({c: F.round(c, 9) for c in ("failure_rate", "root_cause_rate", "safety_claim_rate")})


@query(X.TAGS, **X.VIEWS)
def met_overall(spark, d):
    return E.overall(_evaluated(spark, d))


@query("SELECT prediction_no, task_family FROM unp", **X.VIEWS, unp=X.UNPARSED)
def met_parse_error_rows(spark, d):
    return E.unparsed_rows(_evaluated(spark, d)).select("prediction_no", "task_family")


@query(X.FAILURE_SQL, **X.FAILURE_VIEWS)
def met_failure_analysis(spark, d):
    return E.failure_analysis(_evaluated(spark, d))


# 2.4 joins


@query("SELECT p.prediction_no, r.instruction_id, r.task_family AS task FROM pred p JOIN rec r ON p.instruction_id = r.instruction_id")
def join_pred_inner(spark, d):
    return predictions(spark, d).select("prediction_no", "instruction_id").join(records(spark, d).select("instruction_id", F.col("task_family").alias("task")), "instruction_id")


@query("""SELECT coalesce(t.instruction_id, p.instruction_id) AS instruction_id, CASE WHEN p.instruction_id IS NULL THEN 'missing' ELSE 'extra' END AS side
  FROM (SELECT instruction_id FROM rec WHERE split = 'test') t FULL JOIN (SELECT DISTINCT instruction_id FROM pred) p ON t.instruction_id = p.instruction_id WHERE t.instruction_id IS NULL OR p.instruction_id IS NULL""")
def join_coverage_full(spark, d):
    return J.coverage(records(spark, d).filter("split = 'test'"), predictions(spark, d), "instruction_id")


@query("SELECT DISTINCT instruction_id FROM pred WHERE instruction_id NOT IN (SELECT instruction_id FROM rec WHERE split = 'validation')")
def join_pred_subset_anti(spark, d):
    return predictions(spark, d).select("instruction_id").distinct().join(records(spark, d).filter("split = 'validation'").select("instruction_id"), "instruction_id", "left_anti")


@query("SELECT DISTINCT image_id FROM rec WHERE split = 'train' AND image_id IN (SELECT image_id FROM rec WHERE split IN ('validation', 'test'))")
def join_semi_overlap(spark, d):
    r = records(spark, d)
    return J.overlap(r.filter("split = 'train'"), r.filter("split IN ('validation', 'test')"), "image_id")


@query("SELECT instruction_id FROM rec WHERE split = 'test' AND instruction_id NOT IN (SELECT instruction_id FROM pred WHERE prediction IS NOT NULL) AND instruction_id NOT IN (SELECT instruction_id FROM pred WHERE error IS NOT NULL)")
def join_resume_anti(spark, d):
    p = predictions(spark, d)
    return J.pending(records(spark, d).filter("split = 'test'").select("instruction_id"), p.filter("prediction IS NOT NULL"), "instruction_id", p.filter("error IS NOT NULL"))


def _templates(spark):
    order = V.NORMAL_FIRST + [t[1] for t in V.TEMPLATES if t[1] not in V.NORMAL_FIRST]
    rows = [(*t, i, order.index(t[1])) for i, t in enumerate(V.TEMPLATES)]
    return spark.createDataFrame(rows, "task_family string, template_id string, prompt string, answer_format string, kind string, ordinal int, normal_ordinal int")


_T_ORDER = V.NORMAL_FIRST + [t[1] for t in V.TEMPLATES if t[1] not in V.NORMAL_FIRST]
_T_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t[0]}', '{t[1]}', {i}, {_T_ORDER.index(t[1])})" for i, t in enumerate(V.TEMPLATES)) + ") AS t(task_family, template_id, ordinal, normal_ordinal)"


@query("SELECT i.image_id || '__' || t.template_id AS instruction_id, t.task_family FROM img i JOIN tpl t ON CASE WHEN i.condition = 'anomalous' THEN t.ordinal < 20 ELSE t.normal_ordinal < 3 END", tpl=_T_SQL)
def join_template_cross(spark, d):
    return J.template_cross(images(spark, d).select("image_id", "condition"), _templates(spark), 3, 20).select(F.concat_ws("__", "image_id", "template_id").alias("instruction_id"), "task_family")


def _mistakes(spark, d):
    """Weights per (kind, category, item): wrong defects and locations of the validation predictions."""
    ids = records(spark, d, "instruction_id", "split").filter("split = 'validation'").select("instruction_id")
    p = cut_lineage(predictions(spark, d, *_EVALUATION_COLUMNS).join(ids, "instruction_id", "left_semi"), "validation")
    return cut_lineage(E.error_profile(cut_lineage(E.evaluated(E.parsed(p)), "evaluated")), "weights")


_WEIGHED_COLUMNS = ["instruction_id", "task_family", "condition", "category", "defect_type", "location"]


@query("SELECT instruction_id, score FROM weighed", **X.HARD_VIEWS)
def join_weight_lookup(spark, d):
    return E.hard_scores(records(spark, d, *_WEIGHED_COLUMNS), _mistakes(spark, d)).select("instruction_id", "score")


# 2.7 windows and samples


@query("""SELECT category, condition, n, CAST(n_train AS BIGINT) AS n_train, CAST(n_validation AS BIGINT) AS n_validation, CAST(n - n_train - n_validation AS BIGINT) AS n_test FROM lr""",
       lr="""SELECT category, condition, n, ft + (bt < l)::INT AS n_train, fv + (bv < l)::INT AS n_validation FROM (SELECT *, (pv > pt)::INT + (pe > pt)::INT AS bt, (pt >= pv)::INT + (pe >= pv)::INT AS bv FROM (
         SELECT *, n - ft - fv - fe AS l, xt - ft AS pt, xv - fv AS pv, xe - fe AS pe FROM (SELECT *, floor(xt) AS ft, floor(xv) AS fv, floor(xe) AS fe FROM (
         SELECT *, n * 0.70::DOUBLE AS xt, n * 0.15::DOUBLE AS xv, n * (1.0::DOUBLE - 0.70::DOUBLE - 0.15::DOUBLE) AS xe FROM (SELECT category, condition, count(*) AS n FROM img GROUP BY ALL)))))""")
def win_largest_remainder(spark, d):
    n = images(spark, d).groupBy("category", "condition").agg(F.count("*").alias("n"))
    return n.select("category", "condition", "n", *(c.alias(f"n_{s}") for s, c in S.largest_remainder(F.col("n")).items()))


_CLUSTER = """SELECT cluster, image_id, category, condition, defect_type, members FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ingested_at, image_id) AS r, count(*) OVER (PARTITION BY cluster) AS members
  FROM (SELECT *, coalesce('sha256:' || sha256, 'id:' || image_id) AS cluster FROM img)) WHERE r = 1"""


@query("SELECT cluster, image_id, members FROM clu", clu=_CLUSTER)
def win_duplicate_cluster(spark, d):
    return S.duplicate_clusters(images(spark, d), "ingested_at").select("cluster", "image_id", "members")


_RR = """SELECT *, row_number() OVER (PARTITION BY category, condition ORDER BY round, size DESC, sha256('42:' || defect_key)) AS position FROM (
  SELECT *, count(*) OVER (PARTITION BY category, condition, defect_key) AS size, row_number() OVER (PARTITION BY category, condition, defect_key ORDER BY sha256('42:' || cluster), cluster) AS round
  FROM (SELECT *, CASE WHEN condition = 'normal' THEN 'normal' ELSE coalesce(defect_type, 'unspecified_anomaly') END AS defect_key FROM clu))"""


@query("SELECT cluster, defect_key, round, position FROM rr", clu=_CLUSTER, rr=_RR)
def win_defect_round_robin(spark, d):
    return S.defect_round_robin(cut_lineage(S.duplicate_clusters(images(spark, d), "ingested_at"), "clusters"), SEED, "cluster").select("cluster", "defect_key", "round", "position")


_CONT = """SELECT rr.cluster, CASE WHEN position <= n_train THEN 'train' WHEN position <= n_train + n_validation THEN 'validation' ELSE 'test' END AS split FROM rr JOIN lr ON rr.category IS NOT DISTINCT FROM lr.category AND rr.condition IS NOT DISTINCT FROM lr.condition"""


@query("SELECT image_id, coalesce('sha256:' || sha256, 'id:' || image_id) AS cluster, split FROM img JOIN con ON con.cluster = coalesce('sha256:' || sha256, 'id:' || image_id)", clu=_CLUSTER, rr=_RR,
       lr="""SELECT category, condition, n, ft + (bt < l)::INT AS n_train, fv + (bv < l)::INT AS n_validation FROM (SELECT *, (pv > pt)::INT + (pe > pt)::INT AS bt, (pt >= pv)::INT + (pe >= pv)::INT AS bv FROM (
         SELECT *, n - ft - fv - fe AS l, xt - ft AS pt, xv - fv AS pv, xe - fe AS pe FROM (SELECT *, floor(xt) AS ft, floor(xv) AS fv, floor(xe) AS fe FROM (
         SELECT *, n * 0.70::DOUBLE AS xt, n * 0.15::DOUBLE AS xv, n * (1.0::DOUBLE - 0.70::DOUBLE - 0.15::DOUBLE) AS xe FROM (SELECT category, condition, count(*) AS n FROM clu GROUP BY ALL)))))""", con=_CONT)
def win_contiguous_assign(spark, d):
    return S.assign_splits(cut_lineage(images(spark, d), "images"), "ingested_at", SEED)


_TEST = "SELECT * FROM rec WHERE split = 'test' AND task_family IS NOT NULL"


@query("SELECT instruction_id, task_family FROM (SELECT t.*, q.quota, row_number() OVER (PARTITION BY task_family ORDER BY sha256('42:' || instruction_id), instruction_id) AS r FROM tst t JOIN q USING (task_family)) WHERE r <= quota", tst=_TEST, q=_QUOTA)
def win_quota_sample(spark, d):
    rows = cut_lineage(records(spark, d).filter("split = 'test' AND task_family IS NOT NULL").select("instruction_id", "task_family"), "test")
    return S.quota_sample(rows, _quotas(spark), "task_family", "instruction_id", SEED)


@query("SELECT instruction_id FROM rec ORDER BY sha256('42:' || instruction_id) LIMIT 500")
def win_limit_sample(spark, d):
    return S.limit_sample(cut_lineage(records(spark, d).select("instruction_id"), "records"), 500, "instruction_id", SEED)


def _hard(spark, d, weights=None):
    """Train records that may be selected, with the weight of the mistakes that they share."""
    pool = records(spark, d, *_WEIGHED_COLUMNS, "split").filter("split = 'train' AND task_family IS NOT NULL AND condition IS NOT NULL AND category IS NOT NULL")
    return cut_lineage(E.hard_scores(pool, _mistakes(spark, d) if weights is None else weights).select("instruction_id", "task_family", "condition", "category", "score"), "hard")


@query("SELECT instruction_id, task_family, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_family ORDER BY score DESC, sha256('42:' || instruction_id)) AS rank FROM hard) WHERE rank <= 50", **X.HARD_VIEWS)
def win_hard_rank(spark, d):
    return S.hard_rank(_hard(spark, d), SEED, "task_family", 50).select("instruction_id", "task_family", "score", "rank")


_FLOORS = "SELECT *, row_number() OVER (PARTITION BY task_family, category ORDER BY score DESC, sha256('42:' || instruction_id)) <= 2 AS is_floor FROM hard"


@query("SELECT instruction_id, task_family, category FROM flo WHERE is_floor", **X.HARD_VIEWS, flo=_FLOORS)
def win_category_floor(spark, d):
    return S.category_floor(_hard(spark, d), 2, SEED).select("instruction_id", "task_family", "category")


_BIG = "SELECT unnest(%s) AS task_family, unnest([100, 90, 80, 80, 70, 90, 60, 60]) AS quota" % V.TASKS
_BIGS = dict(zip(V.TASKS, [100, 90, 80, 80, 70, 90, 60, 60]))


@query("SELECT instruction_id, task_family, is_floor FROM (SELECT f.*, b.quota, row_number() OVER (PARTITION BY task_family ORDER BY is_floor DESC, score DESC, sha256('42:' || instruction_id)) AS r FROM flo f JOIN b USING (task_family)) WHERE r <= quota", **X.HARD_VIEWS, flo=_FLOORS, b=_BIG)
def win_fill_to_quota(spark, d):
    quotas = spark.createDataFrame(list(_BIGS.items()), "task_family string, quota bigint")
    return S.floor_then_fill(_hard(spark, d), quotas, SEED, 2).select("instruction_id", "task_family", "is_floor")


_COND = "SELECT task_family, condition, CASE condition WHEN 'anomalous' THEN 80 ELSE 60 END AS quota FROM (SELECT DISTINCT task_family, condition FROM hard)"


def _condition_quotas(rows):
    return rows.select("task_family", "condition").distinct().withColumn("quota", F.when(F.col("condition") == "anomalous", 80).otherwise(60).cast("bigint"))


@query("SELECT instruction_id, task_family, condition, is_floor FROM (SELECT f.*, c.quota, row_number() OVER (PARTITION BY task_family, condition ORDER BY is_floor DESC, score DESC, sha256('42:' || instruction_id)) AS r FROM flo f JOIN c USING (task_family, condition)) WHERE r <= quota", **X.HARD_VIEWS, flo=_FLOORS, c=_COND)
def win_condition_quota(spark, d):
    rows = _hard(spark, d)
    return S.floor_then_fill(rows, _condition_quotas(rows), SEED, 2, ["task_family", "condition"]).select("instruction_id", "task_family", "condition", "is_floor")


_UFR = """SELECT instruction_id, task_family, row_number() OVER (PARTITION BY task_family ORDER BY is_first DESC, turn, s) AS rank, quota FROM (
  SELECT *, row_number() OVER (PARTITION BY task_family, s, is_first ORDER BY CASE WHEN NOT is_first THEN k < coalesce(last_first, '') END, k) AS turn FROM (
  SELECT *, max(CASE WHEN is_first THEN k END) OVER (PARTITION BY task_family, s) AS last_first FROM (
  SELECT *, row_number() OVER (PARTITION BY task_family, image_id ORDER BY k) = 1 AS is_first FROM (
  SELECT t.instruction_id, t.image_id, t.task_family, q.quota,
    sha256('42|' || task_family || '|' || {s} || '|' || instruction_id) AS k, sha256('42|' || task_family || '|' || {s}) AS s FROM tst t JOIN q USING (task_family) WHERE image_id IS NOT NULL))))""".format(s=" || '|' || ".join(f"coalesce({c}, 'none')" for c in S.STRATUM))


@query("SELECT instruction_id, task_family, rank FROM u WHERE rank <= quota", tst=_TEST, q=_QUOTA, u=_UFR)
def win_unique_first_rr(spark, d):
    rows = cut_lineage(records(spark, d).filter("split = 'test' AND task_family IS NOT NULL AND image_id IS NOT NULL").select("instruction_id", "image_id", "task_family", *S.STRATUM), "test")
    return S.unique_first_round_robin(rows, _quotas(spark), SEED).select("instruction_id", "task_family", "rank")


@query("""SELECT instruction_id FROM (SELECT instruction_id, task_family, category, row_number() OVER (PARTITION BY task_family, category ORDER BY sha256('42:' || instruction_id)) AS turn FROM rec WHERE task_family IS NOT NULL AND category IS NOT NULL)
  ORDER BY turn, task_family, category LIMIT 200""")
def win_stratified_rr(spark, d):
    rows = cut_lineage(records(spark, d).filter("task_family IS NOT NULL AND category IS NOT NULL").select("instruction_id", "task_family", "category"), "records")
    return S.stratified_round_robin(rows, ["task_family", "category"], 200, SEED, "instruction_id").select("instruction_id")


@query("SELECT instruction_id FROM rec WHERE split = 'test' AND instruction_id NOT IN (SELECT instruction_id FROM pred WHERE prediction IS NOT NULL) ORDER BY delivery_id LIMIT 100")
def win_stop_after(spark, d):
    left = J.pending(records(spark, d).filter("split = 'test'").select("instruction_id", "delivery_id"), predictions(spark, d).filter("prediction IS NOT NULL"), "instruction_id")
    return left.orderBy("delivery_id").limit(100).select("instruction_id")


# 2.3 gates


@query("""SELECT name, kind, bound, value, CASE WHEN value IS NULL THEN false WHEN kind = 'min' THEN value >= bound ELSE value <= bound END AS passed
  FROM (VALUES ('accuracy', 'min', 0.5), ('unparsed_rate', 'max', 0.2), ('missing', 'min', 0.1)) AS t(name, kind, bound)
  LEFT JOIN (SELECT 'accuracy' AS name, round(sum(n) FILTER (truth = predicted) / sum(n), 9) AS value FROM cells UNION ALL SELECT 'unparsed_rate', round(coalesce(sum(n) FILTER (predicted = '__unparsed__'), 0) / sum(n), 9) FROM cells) USING (name)""".replace("0.5)", "0.5::DOUBLE)"), **_METRIC_VIEWS)
def prj_threshold_gate(spark, d):
    m = M.classification_overall(_binary(spark, d), "truth", "said")
    long = m.selectExpr("stack(2, 'accuracy', accuracy, 'unparsed_rate', unparsed_rate) AS (name, value)").withColumn("value", F.round("value", 9))
    bounds = spark.createDataFrame([("accuracy", "min", 0.5), ("unparsed_rate", "max", 0.2), ("missing", "min", 0.1)], "name string, kind string, bound double")
    return C.threshold_gate(long, bounds)


# 2.11 streams


@query("SELECT event_id, sha256(props) AS result FROM events")
def strm_resume_log(spark, d):
    from sightline.storage import scratch_path
    from sightline.streaming.resume import run_once

    work, log, state = table(spark, d, "events").select("event_id", "props"), scratch_path(spark, "log"), scratch_path(spark, "state")
    source = scratch_path(spark, "work")
    work.write.parquet(source)
    for _ in range(2):  # the second run finds nothing to do
        run_once(spark, source, work.schema, log, state, "event_id", lambda df: df.select("event_id", F.sha2("props", 256).alias("result")))
    return spark.read.parquet(log)


__all__ = ["FLAGSHIP", "QUERIES", "SQL", "Window", "documents"]
