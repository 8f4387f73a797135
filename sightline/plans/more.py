"""Further queries of the core: single functions, set operations, composed pipelines and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import answers, geometry, hashing, parsers, text
from sightline.functions import vocabulary as V
from sightline.operators import aggregates as A
from sightline.operators import evaluation as E
from sightline.operators import joins as J
from sightline.operators import metrics as M
from sightline.operators import sampling as S
from sightline.operators import validate as C
from sightline.plans import catalog as K
from sightline.plans import evaluation_sql as X
from sightline.plans import parser_sql as P
from sightline.plans.catalog import QUERIES, SEED, SQL, query
from sightline.plans.views import images, predictions, records, table, token_sql
from sightline.storage import cut_lineage, scratch_path

# 2.9 scalar functions, one by one


@query("SELECT DISTINCT category AS raw, translate(lower(category), ' -', '__') AS token FROM images")
def fn_norm_token(spark, d):
    return table(spark, d, "images").select(F.col("category").alias("raw"), text.norm_token("category").alias("token")).distinct()


@query(f"SELECT DISTINCT task_family AS raw, {P.label('task_family')} AS label FROM instructions")
def fn_norm_label(spark, d):
    return table(spark, d, "instructions").select(F.col("task_family").alias("raw"), text.norm_label("task_family").alias("label")).distinct()


@query(r"""SELECT DISTINCT defect_type AS raw, array_to_string(list_filter(list_transform(string_split(coalesce(defect_type, ''), ','), lambda x: lower(trim(regexp_replace(replace(x, '_', ' '), '\s+', ' ', 'g')))), lambda x: x <> ''), ', ') AS meta FROM rec""")
def fn_norm_meta(spark, d):
    return records(spark, d).select(F.col("defect_type").alias("raw"), text.norm_meta("defect_type").alias("meta")).distinct()


@query(r"SELECT prediction_no, sha256(lower(trim(regexp_replace(replace(prediction, '<|im_end|>', ''), '\s+', ' ', 'g')))) AS decoded FROM pred WHERE prediction IS NOT NULL")
def fn_norm_decoded(spark, d):
    return predictions(spark, d).filter("prediction IS NOT NULL").select("prediction_no", F.sha2(text.norm_decoded("prediction"), 256).alias("decoded"))


_HUMAN = "coalesce(replace(replace(nullif({0}, ''), '_', ' '), ',', ', '), 'unspecified visual anomaly')"


@query(f"SELECT DISTINCT nine_grid_location, {_HUMAN.format('nine_grid_location')} AS place FROM img")
def fn_location_text(spark, d):
    return images(spark, d, "image_id", "nine_grid_location").select("nine_grid_location", answers.location_text().alias("place")).distinct()


@query(f"SELECT image_id, CASE WHEN condition = 'anomalous' THEN 'defective' ELSE 'normal' END AS status, {_HUMAN.format('nine_grid_location')} AS place, {_HUMAN.format('defect_type')} AS defect FROM img")
def fn_humanize(spark, d):
    return images(spark, d).select("image_id", answers.status().alias("status"), answers.location_text().alias("place"), text.humanize(F.nullif("defect_type", F.lit("")), answers.MISSING).alias("defect"))


@query("SELECT image_id, CASE WHEN condition = 'anomalous' THEN 'defective' ELSE 'normal' END AS status FROM img")
def fn_status(spark, d):
    return images(spark, d).select("image_id", answers.status().alias("status"))


_ANSWER_PARTS = {"defect": _HUMAN.format("defect_type"), "place": _HUMAN.format("nine_grid_location"), "category": "category", "severity": "visual_severity", "percent": "printf('%.3f', anomaly_area_ratio * 100)"}


def _filled(form: str) -> str:
    return " || ".join(x for words, name in answers.pieces(form) for x in ([f"'{words}'"] if words else []) + ([_ANSWER_PARTS[name]] if name else []))


_ANSWER_SQL = {kind: f"CASE WHEN condition = 'normal' THEN {_filled(normal)} ELSE {_filled(other)} END" for kind, (normal, other) in answers.WORDING.items()}


def _answer(kind: str):
    def run(spark, d):
        return images(spark, d).select("image_id", answers.answers()[kind].alias("answer"))

    run.__name__ = f"fn_answer_{kind}"
    return run


for _kind in answers.WORDING:
    query(f"SELECT image_id, {_ANSWER_SQL[_kind]} AS answer FROM img")(_answer(_kind))


@query("""SELECT image_id, json_extract_string(j, '$.product') AS product, json_extract_string(j, '$.condition') AS condition, json_extract_string(j, '$.visual_severity') AS severity FROM (SELECT image_id, '{"product": "' || category || '", "condition": "' ||
  CASE WHEN condition = 'anomalous' THEN 'defective' ELSE 'normal' END || '", "visual_severity": "' || visual_severity || '"}' AS j FROM img)""")
def fn_json_answer(spark, d):
    j = images(spark, d).select("image_id", F.try_parse_json(answers.answers()["json"]).alias("j"))
    return j.select("image_id", *(F.try_variant_get("j", f"$.{k}", "string").alias(a) for k, a in (("product", "product"), ("condition", "condition"), ("visual_severity", "severity"))))


@query("SELECT image_id, sha256('42:' || image_id) AS k FROM img")
def fn_tie_breaker(spark, d):
    return images(spark, d).select("image_id", hashing.tie_breaker(F.lit(SEED), "image_id").alias("k"))


@query("SELECT DISTINCT category, condition, ('0x' || substr(sha256('42:(''' || category || ''', ''' || condition || ''')'), 1, 8))::BIGINT AS seed FROM img WHERE category IS NOT NULL AND condition IS NOT NULL")
def fn_stratum_seed(spark, d):
    key = F.concat(F.lit("42:('"), "category", F.lit("', '"), "condition", F.lit("')"))
    seed = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return images(spark, d).filter("category IS NOT NULL AND condition IS NOT NULL").select("category", "condition", seed.alias("seed")).distinct()


@query(r"SELECT instruction_id, CAST(len(list_filter(regexp_split_to_array(coalesce(prompt, ''), '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM rec")
def fn_word_count(spark, d):
    return records(spark, d).select("instruction_id", text.word_count("prompt").alias("words"))


@query("SELECT image_id, area, ratio FROM f", f=K._FEATURES)
def fn_area_ratio(spark, d):
    return K._features(spark, d).select("image_id", "area", "ratio")


@query(f"SELECT image_id, {V.LOCATIONS!r}[CAST(least(floor(cy / 8 * 3), 2) * 3 + least(floor(cx / 8 * 3), 2) AS INT) + 1] AS cell FROM f", f=K._FEATURES)
def fn_nine_grid(spark, d):
    return K._features(spark, d).select("image_id", geometry.nine_grid("x_normalized", "y_normalized").alias("cell"))


_NONE = "bounding_box IS NULL AND centroid IS NULL AND nine_grid_location IS NULL"
_ALL = "coalesce(bounding_box IS NOT NULL AND centroid IS NOT NULL AND nine_grid_location IS NOT NULL, false)"
_DERIVED = {
    "anomalous_without_area": "c = 'anomalous' AND NOT coalesce(anomaly_area_pixels > 0, false)", "anomalous_without_features": f"c = 'anomalous' AND NOT {_ALL}", "anomalous_without_severity": "c = 'anomalous' AND coalesce(v = 'none', true)",
    "box_height": "bounding_box.height <> bounding_box.y_max - bounding_box.y_min + 1", "box_width": "bounding_box.width <> bounding_box.x_max - bounding_box.x_min + 1", "normal_with_area": "c = 'normal' AND (anomaly_area_pixels <> 0 OR anomaly_area_ratio <> 0)",
    "normal_with_features": f"c = 'normal' AND NOT ({_NONE})", "normal_with_severity": "c = 'normal' AND v IS DISTINCT FROM 'none'",
}


@query(f"SELECT image_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {rule} THEN {name!r} END' for name, rule in _DERIVED.items())}], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT *, {token_sql('condition')} AS c, {token_sql('visual_severity')} AS v FROM images)")
def fn_derive_record(spark, d):
    """Derived columns of the image rows against their own rules."""
    rows = table(spark, d, "images")
    cols = {"condition": text.canonical_token("condition"), "area": F.col("anomaly_area_pixels"), "ratio": F.col("anomaly_area_ratio"), "box": F.col("bounding_box"), "centroid": F.col("centroid"), "location": F.col("nine_grid_location"), "severity": text.canonical_token("visual_severity")}
    return rows.select("image_id", F.array_join(geometry.derived_problems(cols), ",").alias("problems"))


@query(f"SELECT DISTINCT defect_type, array_to_string({P.canonical(P.atoms('defect_type'))}, '+') AS canonical FROM rec")
def fn_canon_atom(spark, d):
    return records(spark, d).select("defect_type", F.array_join(parsers.canonical_atoms(text.split_compound("defect_type")), "+").alias("canonical")).distinct()


@query(f"SELECT DISTINCT defect_type, coalesce(nullif(array_to_string({P.atoms('defect_type')}, '+'), ''), '**unparsed**') AS label FROM rec")
def fn_label(spark, d):
    return records(spark, d).select("defect_type", E.set_label(text.split_compound("defect_type")).alias("label")).distinct()


@query("SELECT image_id, CASE WHEN condition = 'normal' THEN 'normal' ELSE coalesce(defect_type, 'unspecified_anomaly') END AS k FROM img")
def fn_defect_key(spark, d):
    key = F.when(F.col("condition") == "normal", "normal").otherwise(F.coalesce("defect_type", F.lit("unspecified_anomaly")))
    return images(spark, d).select("image_id", key.alias("k"))


@query("SELECT image_id, concat_ws('|', category, condition) AS s2 FROM img")
def fn_stratum_2(spark, d):
    return images(spark, d, "image_id", "category", "condition").select("image_id", F.concat_ws("|", "category", "condition").alias("s2"))


@query("SELECT DISTINCT " + " || '|' || ".join(f"coalesce({c}, 'none')" for c in S.STRATUM) + " AS s5 FROM rec")
def fn_stratum_5(spark, d):
    return records(spark, d).select(F.concat_ws("|", *(F.coalesce(c, F.lit("none")) for c in S.STRATUM)).alias("s5")).distinct()


@query("SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 'cpu_only' WHEN value < 16 THEN 'under_16' WHEN value < 32 THEN 'under_32' ELSE 'large' END AS bucket FROM events")
def fn_vram_bucket(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v.isNull() | (v <= 0), "cpu_only").when(v < 16, "under_16").when(v < 32, "under_32").otherwise("large").alias("bucket"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def fn_date(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT run_id, e.key AS task, e.value AS quota FROM (SELECT run_id, unnest(map_entries(train_task_quotas)) AS e FROM train_runs)")
def fn_map(spark, d):
    return table(spark, d, "train_runs").select("run_id", F.explode("train_task_quotas").alias("task", "quota"))


# 2.3


_HEADERS = ["Object Name", "Set-Type", "Label", "img path", "GT_path"]


@query("SELECT * FROM (VALUES ('object', 'Object Name'), ('split', 'Set-Type'), ('label', 'Label'), ('image', 'img path'), ('mask', 'GT_path')) AS t(canonical, found)")
def prj_header_alias(spark, d):
    return spark.createDataFrame(list(C.resolve_headers(_HEADERS).items()), "canonical string, found string")


@query("SELECT image_id, list_filter(list_transform(list_filter(string_split(image_path, '/'), lambda x: x <> ''), lambda x: translate(lower(x), ' -', '__')), lambda x: x IN %s)[1] AS category FROM img" % K._strings(V.CATEGORIES))
def prj_find_category(spark, d):
    return images(spark, d).select("image_id", C.find_category("image_path").alias("category"))


@query(r"SELECT image_id, regexp_replace(replace(image_path, '/Images/', '/Masks/'), '\.[^./]*$', '.png') AS mask FROM img")
def prj_candidate_mask(spark, d):
    return images(spark, d).select("image_id", C.candidate_mask("image_path").alias("mask"))


@query("SELECT image_id, CASE WHEN 'data/' || p IN (SELECT image_path FROM img) THEN 'data/' || p ELSE 'csv/' || p END AS resolved FROM (SELECT image_id, regexp_replace(image_path, '^data/', '') AS p FROM img WHERE image_path IS NOT NULL)")
def prj_resolve_path(spark, d):
    i = images(spark, d).filter("image_path IS NOT NULL")
    rows = i.select("image_id", C.path_candidates(F.regexp_replace("image_path", "^data/", ""), F.lit("csv"), "data").alias("candidates"))
    return C.resolve_path(rows, "candidates", i.select(F.col("image_path").alias("path")), "image_id").select("image_id", "resolved")


@query(f"SELECT DISTINCT source_split AS raw, CASE WHEN {P.name("coalesce(source_split, '')")} IN ('train', 'training') THEN 'train' WHEN {P.name("coalesce(source_split, '')")} IN ('test', 'testing', 'validation', 'val') THEN 'test' ELSE 'unknown' END AS split FROM images")
def prj_parse_split(spark, d):
    return table(spark, d, "images").select(F.col("source_split").alias("raw"), C.parse_source_split("source_split").alias("split")).distinct()


@query(f"""SELECT DISTINCT category, CASE WHEN nullif({P.name("category")}, '') IS NOT NULL AND {P.name("category")} <> 'pcb1' THEN 'category differs from folder' WHEN coalesce(nullif({P.name("category")}, ''), 'pcb1') NOT IN {K._strings(V.CATEGORIES)} THEN 'unexpected category' END AS error FROM images""")
def prj_category_rule(spark, d):
    return table(spark, d, "images").select("category", C.category_error("category", F.lit("pcb1")).alias("error")).distinct()


@query(f"SELECT DISTINCT defect_type, condition, coalesce(nullif({P.name("coalesce(defect_type, '')")}, ''), condition) AS defect FROM images")
def prj_defect_override(spark, d):
    return table(spark, d, "images").select("defect_type", "condition", C.defect_override("defect_type", "condition").alias("defect")).distinct()


@query("SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM parsed_rows GROUP BY 1", **K._RECORD_VIEWS)
def prj_error_split(spark, d):
    """Valid rows and dead letters of the annotation rows, counted by error."""
    valid, dead = C.split_errors(K.prj_row_to_record(spark, d))
    return valid.select(F.lit("valid").alias("error")).unionByName(dead.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT count(*) > 0 AS would_raise FROM rec WHERE task_family IS NULL OR task_family NOT IN %s" % K._strings(V.TASKS))
def prj_strict_gate(spark, d):
    dead = records(spark, d).filter(~F.coalesce(F.col("task_family").isin(V.TASKS), F.lit(False)))
    try:
        C.strict_gate(dead, strict=True)
        raised = False
    except ValueError:
        raised = True
    return spark.createDataFrame([(raised,)], "would_raise boolean")


@query(r"SELECT DISTINCT image, nullif(regexp_extract(replace(image, '\', '/'), '(?i)(?:^|/)(data/raw/visa(?:/.*)?)$', 1), '') AS suffix FROM rec WHERE image IS NOT NULL")
def prj_path_suffix_normalise(spark, d):
    return records(spark, d).filter("image IS NOT NULL").select("image", C.path_suffix("image").alias("suffix")).distinct()


_STATUS = "CASE WHEN error IS NOT NULL THEN 'fail' WHEN prediction IS NULL THEN 'pending' ELSE 'pass' END"


@query(f"""SELECT pass, pending, fail, CASE WHEN fail > 0 THEN 'blocked' WHEN pending > 0 THEN 'pending' ELSE 'ready' END AS state FROM (
  SELECT count(*) FILTER (s = 'pass') AS pass, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'fail') AS fail FROM (SELECT {_STATUS} AS s FROM pred))""")
def prj_release_status(spark, d):
    return C.release_status(predictions(spark, d).select(F.expr(_STATUS).alias("status")))


# 2.4


_FINAL = {
    "work": "SELECT u.run_id, r.instruction_id, r.delivery_id AS ordinal FROM rec r JOIN inference_runs u ON r.split = u.expected_dataset_split",
    "both_sides": """SELECT run_id, instruction_id, ordinal, task_family, prediction_no, CASE WHEN d.found IS NULL THEN 'missing' WHEN w.asked IS NULL THEN 'extra' ELSE 'both' END AS side
  FROM (SELECT *, true AS asked FROM work) w FULL JOIN (SELECT run_id, instruction_id, task_family, prediction_no, true AS found FROM pred WHERE prediction IS NOT NULL) d USING (run_id, instruction_id)""",
}


@query("SELECT *, bool_and(side = 'both') OVER (PARTITION BY run_id) AS complete FROM both_sides", **_FINAL)
def join_finalize_order(spark, d):
    """All runs against the records of the split that each is to answer, in the order of delivery; failed generations are missing."""
    runs = table(spark, d, "inference_runs").select("run_id", F.col("expected_dataset_split").alias("split"))
    work = records(spark, d, "instruction_id", "split", "delivery_id").withColumnRenamed("delivery_id", "ordinal").join(runs, "split").drop("split")
    done = predictions(spark, d, "run_id", "instruction_id", "task_family", "prediction_no", "prediction").filter("prediction IS NOT NULL").drop("prediction")
    return J.finalize_runs(work, done, "run_id", "instruction_id", "ordinal")


_STEM = r"([^/]+)\.[^./]*$"


def _category_of(path: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split({path}, '/'), lambda x: x <> ''), lambda x: translate(lower(x), ' -', '__')), lambda x: list_contains({V.CATEGORIES!r}, x))[1]"


_MASK_VIEWS = {
    "wanted": rf"SELECT image_id, image_path, category, regexp_extract(image_path, '{_STEM}', 1) AS stem, regexp_replace(replace(image_path, '/Images/', '/Masks/'), '\.[^./]*$', '.png') AS wanted FROM img",
    "masks": r"SELECT DISTINCT replace(mask_path, '\', '/') AS path FROM images WHERE mask_path IS NOT NULL",
    "placed_masks": f"SELECT path, {_category_of('path')} AS category, regexp_extract(path, '{_STEM}', 1) AS stem FROM masks",
}


def _masks(spark, d):
    """The distinct mask paths, with the category and stem that they tell."""
    masks = table(spark, d, "images").filter("mask_path IS NOT NULL").select(F.replace("mask_path", F.lit("\\"), F.lit("/")).alias("path")).distinct()
    return masks.withColumns({"category": C.find_category("path"), "stem": F.regexp_extract("path", _STEM, 1)})


@query("""SELECT w.image_id, coalesce(m.path, f.path) AS mask FROM wanted w LEFT JOIN masks m ON m.path = w.wanted
  LEFT JOIN (SELECT category, stem, min(path) AS path FROM placed_masks GROUP BY 1, 2) f ON f.category = w.category AND f.stem = w.stem WHERE w.category IS NOT NULL""", **_MASK_VIEWS)
def join_image_mask(spark, d):
    rows = images(spark, d, "image_id", "image_path", "category").filter("category IS NOT NULL").select("image_id", "category", F.regexp_extract("image_path", _STEM, 1).alias("stem"), C.candidate_mask("image_path").alias("wanted"))
    return J.with_masks(rows, _masks(spark, d)).select("image_id", "mask")


@query("SELECT r.run_id, p.run_id IS NOT NULL AS predicted, coalesce(p.most <= r.max_new_tokens, true) AS within FROM inference_runs r LEFT JOIN (SELECT run_id, max(generated_token_count) AS most FROM pred GROUP BY 1) p ON r.run_id = p.run_id")
def join_manifest_check(spark, d):
    most = predictions(spark, d).groupBy("run_id").agg(F.max("generated_token_count").alias("most"), F.lit(True).alias("seen"))
    both = table(spark, d, "inference_runs").join(most, "run_id", "left")
    return both.select("run_id", F.coalesce("seen", F.lit(False)).alias("predicted"), F.coalesce(F.col("most") <= F.col("max_new_tokens"), F.lit(True)).alias("within"))


# 2.5


@query("""SELECT 'records' AS metric, count(*) AS value FROM rec UNION ALL SELECT 'prompts', count(DISTINCT prompt) FROM rec UNION ALL SELECT 'answers', count(DISTINCT answer) FROM rec UNION ALL SELECT 'images', count(DISTINCT image_id) FROM rec
  UNION ALL SELECT 'repeated_answers', count(*) FROM (SELECT answer FROM rec WHERE answer IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""")
def agg_quality_statistics(spark, d):
    r = cut_lineage(records(spark, d).select("prompt", "answer", "image_id"), "records")
    one = r.agg(F.count("*").alias("records"), F.count_distinct("prompt").alias("prompts"), F.count_distinct("answer").alias("answers"), F.count_distinct("image_id").alias("images"))
    long = one.selectExpr("stack(4, 'records', records, 'prompts', prompts, 'answers', answers, 'images', images) AS (metric, value)")
    return long.unionByName(A.repeated(r, "answer").agg(F.count("*").alias("value")).withColumn("metric", F.lit("repeated_answers")))


@query()
def agg_file_sha256(spark, d):
    """Digests of all files of the tables."""
    from sightline.sources.readers import digests

    return digests(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


_ROW = "SELECT {0}, '{1}' AS kind, {2} AS task_family, {3} AS value, {4} AS n, {5} AS fingerprint FROM {6}"
_BY, _NULL = "run_id, selection", "CAST(NULL AS VARCHAR)"
_AUDIT = {
    "asked": """SELECT run_id, 'validation' AS selection, subset_seed + 1 AS seed, CAST(NULL AS VARCHAR) AS asked_task, validation_limit AS k FROM train_runs
      UNION ALL SELECT run_id, 'train', subset_seed, NULL, train_limit FROM train_runs WHERE train_task_quotas IS NULL
      UNION ALL SELECT run_id, 'train', subset_seed, e.key, e.value FROM (SELECT *, unnest(map_entries(train_task_quotas)) AS e FROM train_runs WHERE train_task_quotas IS NOT NULL)""",
    "short": """SELECT run_id, selection, asked_task, k, coalesce(s.n, 0) AS n FROM asked LEFT JOIN (SELECT task_family AS asked_task, count(*) AS n FROM rec WHERE split = 'train' AND task_family IS NOT NULL GROUP BY 1) s USING (asked_task)
      WHERE asked_task IS NOT NULL AND coalesce(s.n, 0) < k""",
    "able": "SELECT DISTINCT run_id, selection FROM asked WHERE run_id NOT IN (SELECT run_id FROM short)",
    "taken": """SELECT * FROM (SELECT a.run_id, a.selection, a.k, r.instruction_id, r.image_id, r.task_family, r.category, r.condition,
        row_number() OVER (PARTITION BY a.run_id, a.selection, a.asked_task ORDER BY substr(sha256(a.seed || ':' || r.instruction_id), 1, 13), r.instruction_id) AS place
      FROM rec r JOIN asked a ON r.split = a.selection AND (a.asked_task IS NULL OR a.asked_task = r.task_family) WHERE a.run_id NOT IN (SELECT run_id FROM short)) WHERE k IS NULL OR place <= k""",
    "taken_print": X.corpus_print("taken", "run_id, selection"),
    "source_print": X.corpus_print("(SELECT split AS selection, instruction_id FROM rec WHERE split IN ('train', 'validation'))", "selection"),
}


@query(" UNION ALL ".join([
    _ROW.format("a.run_id, a.selection", "records", _NULL, _NULL, "coalesce(p.n, 0)", "p.fingerprint", "able a LEFT JOIN taken_print p USING (run_id, selection)"),
    _ROW.format("a.run_id, a.selection", "ids", _NULL, _NULL, "count(DISTINCT t.instruction_id)", _NULL, "able a LEFT JOIN taken t USING (run_id, selection) GROUP BY 1, 2"),
    _ROW.format("a.run_id, a.selection", "images", _NULL, _NULL, "count(DISTINCT t.image_id)", _NULL, "able a LEFT JOIN taken t USING (run_id, selection) GROUP BY 1, 2"),
    _ROW.format("a.run_id, a.selection", "source", _NULL, _NULL, "coalesce(s.n, 0)", "s.fingerprint", "able a LEFT JOIN source_print s USING (selection)"),
    *(_ROW.format(_BY, c, _NULL, c, "count(*)", _NULL, "taken GROUP BY ALL") for c in ("task_family", "category", "condition")),
    *(_ROW.format(_BY, f"task_{c}", "task_family", c, "count(*)", _NULL, "taken GROUP BY ALL") for c in ("category", "condition")),
    _ROW.format(_BY, "short_quota", "asked_task", "CAST(k AS VARCHAR)", "n", _NULL, "short"),
]), **_AUDIT)
def agg_selection_audit(spark, d):
    """The train and validation selections of every training run: counts, images and fingerprints, over all records."""
    cols = ["split", "instruction_id", "image_id", "task_family", "category", "condition"]
    return A.selection_audit(cut_lineage(records(spark, d, *cols).filter("split IN ('train', 'validation')"), "records"), table(spark, d, "train_runs"))


@query(f"SELECT round(max(coalesce(rate, 0)), 9) AS worst FROM (SELECT task_family, avg(CAST({P.uncertainty('prediction')['unsupported_root_cause']} AS INT)) AS rate FROM pred WHERE prediction IS NOT NULL GROUP BY 1)")
def agg_max_over_tasks(spark, d):
    said = parsers.parse(predictions(spark, d).filter("prediction IS NOT NULL"), "prediction", ["unsupported_root_cause"])
    rates = said.groupBy("task_family").agg(F.avg(F.col("unsupported_root_cause").cast("double")).alias("rate"))
    return rates.agg(F.round(F.coalesce(F.max(F.coalesce("rate", F.lit(0.0))), F.lit(0.0)), 9).alias("worst"))


@query(X.PROFILE, **X.VIEWS)
def agg_error_profile(spark, d):
    return E.error_profile(K._evaluated(spark, d))


@query("SELECT task_family, score, count(*) AS n FROM hard GROUP BY 1, 2", **X.HARD_VIEWS)
def agg_score_histogram(spark, d):
    return K._hard(spark, d).groupBy("task_family", "score").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS images, array_to_string(list_sort(list_filter({V.CATEGORIES!r}, lambda c: NOT list_contains(list(DISTINCT category), c))), ',') AS missing,
  array_to_string(list_sort(list_filter(list(DISTINCT category), lambda c: c IS NOT NULL AND c NOT IN {K._strings(V.CATEGORIES)})), ',') AS unexpected, count(*) FILTER (condition = 'anomalous' AND defect_type IS NULL) AS unlabelled FROM img""")
def agg_audit_summary(spark, d):
    found, expected = F.collect_set("category"), F.array(*map(F.lit, V.CATEGORIES))
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return images(spark, d).agg(F.count("*").alias("images"), joined(expected, found).alias("missing"), joined(found, expected).alias("unexpected"), F.count_if((F.col("condition") == "anomalous") & F.col("defect_type").isNull()).alias("unlabelled"))


# 2.6


@query("SELECT category, round(coalesce(count(*) FILTER (condition = 'anomalous') / nullif(count(*) FILTER (condition = 'normal'), 0), 0)::DOUBLE, 9) AS odds FROM img GROUP BY 1")
def met_safe_divide(spark, d):
    return images(spark, d).groupBy("category").agg(F.round(M.safe_divide(F.count_if(F.col("condition") == "anomalous"), F.count_if(F.col("condition") == "normal")), 9).alias("odds"))


@query(f"""SELECT prediction_no, obj IS NOT NULL AS json_valid, CAST(len(list_intersect(coalesce(json_keys(obj), []), {V.REPORT_KEYS!r})) AS INT) AS present,
  CAST(len(list_filter(list_distinct(coalesce(json_keys(obj), [])), lambda k: k NOT IN {K._strings(V.REPORT_KEYS)})) AS INT) AS unsupported FROM said WHERE task_family = 'structured_report'""", said=K._OBJ)
def met_structured_row(spark, d):
    return K._evaluated(spark, d).filter("task_family = 'structured_report'").select("prediction_no", "json_valid", "present", "unsupported")


@query(f"SELECT prediction_no, round(fact_coverage, 6) AS fact_coverage FROM ev WHERE task_family IN {K._strings(E.FACT_TASKS)}", **X.VIEWS)
def met_fact_coverage(spark, d):
    return K._evaluated(spark, d).filter(F.col("task_family").isin(E.FACT_TASKS)).select("prediction_no", F.round("fact_coverage", 6).alias("fact_coverage"))


@query("SELECT task_family, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in E.PLAIN) + f" FROM tm WHERE task_family IS NULL OR task_family NOT IN {K._strings(E.LABEL_TASKS)} GROUP BY 1", **X.TASK_VIEWS)
def met_per_task_csv(spark, d):
    """A row per task with plain metrics only, as the report has no place for nested ones."""
    return E.plain_metrics(K._evaluated(spark, d)).groupBy("task_family").pivot("metric", E.PLAIN).agg(F.round(F.first("value"), 6))


@query("SELECT 'binary_accuracy' AS name, round(sum(n) FILTER (truth = predicted) / sum(n), 9) AS value FROM cells UNION ALL SELECT 'binary_unparsed_rate', round(coalesce(sum(n) FILTER (predicted = '__unparsed__'), 0) / sum(n), 9) FROM cells", **K._METRIC_VIEWS)
def met_release_metric_map(spark, d):
    m = M.classification_overall(K._binary(spark, d), "truth", "said")
    return m.selectExpr("stack(2, 'binary_accuracy', accuracy, 'binary_unparsed_rate', unparsed_rate) AS (name, value)").withColumn("value", F.round("value", 9))


# 2.7 and 2.8


@query("SELECT instruction_id, task_family FROM (SELECT instruction_id, task_family, row_number() OVER (PARTITION BY task_family ORDER BY sha256('42:' || instruction_id), instruction_id) AS r FROM rec WHERE task_family IS NOT NULL) WHERE r <= 4")
def win_gallery(spark, d):
    rows = cut_lineage(records(spark, d).filter("task_family IS NOT NULL").select("instruction_id", "task_family"), "records")
    return S.quota_sample(rows, rows.select("task_family").distinct().withColumn("quota", F.lit(4).cast("bigint")), "task_family", "instruction_id", SEED)


@query("SELECT location, step, is_best, rank FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY step DESC) AS rank FROM (SELECT run_id AS location, prediction_no AS step, error IS NOT NULL AS is_best FROM pred)) WHERE rank <= 3 OR is_best")
def win_checkpoint_retention(spark, d):
    return S.newest_or_best(predictions(spark, d).select(F.col("run_id").alias("location"), F.col("prediction_no").alias("step"), F.col("error").isNotNull().alias("is_best")), 3)


@query("SELECT task_family, instruction_id, row_number() OVER (ORDER BY task_family, instruction_id) AS rank FROM rec WHERE split = 'test' AND task_family IS NOT NULL")
def srt_multi_key(spark, d):
    """All test records in the order of task and identifier, with their rank."""
    rows = cut_lineage(records(spark, d, "task_family", "instruction_id", "split").filter("split = 'test' AND task_family IS NOT NULL").select("task_family", "instruction_id"), "test")
    return S.ranked_in_order(rows, "task_family", "instruction_id").orderBy("rank")


@query("SELECT template_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, template_id) AS place FROM rec WHERE template_id IS NOT NULL GROUP BY 1")
def srt_mixed_direction(spark, d):
    from pyspark.sql import Window

    counts = records(spark, d).filter("template_id IS NOT NULL").groupBy("template_id").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "template_id")).cast("bigint"))  # one row per template


_LONGEST = sorted(V.LOCATION_ALIASES, key=len, reverse=True)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(_LONGEST)) + ") AS t(place, alias)")
def srt_longest_first(spark, d):
    return spark.createDataFrame(list(enumerate(_LONGEST)), "place int, alias string")


@query("SELECT instruction_id, split FROM rec WHERE split = 'validation' UNION ALL SELECT instruction_id, split FROM rec WHERE split = 'test'")
def set_union_all(spark, d):
    r = cut_lineage(records(spark, d).select("instruction_id", "split"), "records")
    return r.filter("split = 'validation'").unionByName(r.filter("split = 'test'"))


@query("SELECT image_id FROM rec WHERE split = 'train' INTERSECT SELECT image_id FROM rec WHERE split IN ('validation', 'test')")
def set_intersect(spark, d):
    r = records(spark, d).select("image_id", "split")
    return r.filter("split = 'train'").select("image_id").intersect(r.filter("split IN ('validation', 'test')").select("image_id"))


@query("SELECT image_id FROM img EXCEPT SELECT image_id FROM rec")
def set_except(spark, d):
    return images(spark, d).select("image_id").subtract(records(spark, d).select("image_id"))


@query("SELECT DISTINCT category, condition, visual_severity FROM rec")
def set_distinct(spark, d):
    return records(spark, d).select("category", "condition", "visual_severity").distinct()


@query()
def join_assignment(spark, d):
    return K.win_contiguous_assign(spark, d).select("image_id", "split")


SQL["join_assignment"] = SQL["win_contiguous_assign"].replace("SELECT image_id, coalesce('sha256:' || sha256, 'id:' || image_id) AS cluster, split FROM img", "SELECT image_id, split FROM img")


# 2.1 readers over logs that are written first, and 2.11 streams


def _log(spark, d, name: str) -> str:
    path = scratch_path(spark, name)
    table(spark, d, "events").select("event_id", "event_type", "value").write.option("ignoreNullFields", "false").json(path)
    return path


_EVENT = "event_id bigint, event_type string, value double"


@query("SELECT event_id, event_type, value FROM events")
def src_jsonl_strict(spark, d):
    from sightline.sources.readers import jsonl_strict

    return jsonl_strict(spark, _log(spark, d, "strict"), _EVENT)


@query("SELECT event_id, event_type, value FROM events")
def src_jsonl_permissive(spark, d):
    from sightline.sources.readers import jsonl_permissive

    return jsonl_permissive(spark, _log(spark, d, "permissive"), _EVENT)[0]


@query("SELECT event_id, event_type FROM events")
def src_jsonl_dedup_key(spark, d):
    from sightline.sources.readers import unique_keys

    return unique_keys(table(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk_partitioned_jsonl(spark, d):
    from sightline.sources.sinks import partitioned_jsonl

    path = scratch_path(spark, "partitioned")
    partitioned_jsonl(table(spark, d, "events").select("event_id", "event_type"), path, "event_type", "event_id")
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def strm_dedup_state(spark, d):
    source, out, state = (scratch_path(spark, x) for x in ("source", "sink", "state"))
    rows = table(spark, d, "events").select("user_id", "event_type")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source).dropDuplicates(["user_id", "event_type"])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS work, count(*) FILTER (value > 10) AS done, count(*) FILTER (value IS NULL OR value <= 10) AS pending FROM events")
def strm_progress_manifest(spark, d):
    """Progress of a work log of which the larger events are done."""
    from sightline.streaming.resume import progress

    work, log = table(spark, d, "events").select("event_id"), scratch_path(spark, "log")
    table(spark, d, "events").filter("value > 10").select("event_id").write.parquet(log)
    p = progress(spark, log, work, "event_id")
    return spark.createDataFrame([(p["work"], p["done"], p["pending"])], "work bigint, done bigint, pending bigint")
