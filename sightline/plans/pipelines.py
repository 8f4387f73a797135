"""Whole pipelines of section 2.10, each in long form: what its files would hold, one part after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sightline.functions import answers, geometry, text
from sightline.functions import vocabulary as V
from sightline.operators import aggregates as A
from sightline.operators import evaluation as E
from sightline.operators import joins as J
from sightline.operators import sampling as S
from sightline.operators import validate as C
from sightline.plans import catalog as K
from sightline.plans import evaluation_sql as X
from sightline.plans import more, round_trips
from sightline.plans.catalog import SEED, SQL, query
from sightline.plans.views import id_sql, images, predictions, records, table
from sightline.sources import readers
from sightline.storage import cut_lineage

# parts as (part, key, value, n)


def _part(df, part: str, key, value=None, n=None):
    plain = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return df.select(F.lit(part).alias("part"), plain(key).alias("key"), plain(value).alias("value"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def _parts(*parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counted(df, dims: list[str], prefix: str = "count"):
    return _part(A.counts_1d(df, dims), prefix, F.col("dim"), F.col("value"), F.col("n"))


def _sql(part: str, table_: str, key: str, value: str = "NULL", n: str = "1", tail: str = "") -> str:
    return f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, CAST({value} AS VARCHAR) AS value, CAST({n} AS BIGINT) AS n FROM {table_} {tail}"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _counted_sql(table_: str, dims: list[str], prefix: str = "count") -> list[str]:
    return [_sql(prefix, table_, f"'{c}'", c, "count(*)", f"GROUP BY {c}") for c in dims]


# audit, parse, features


_AUDIT_DIMS = ["category", "condition"]
_TOKENS = "list_transform(list_filter(string_split(image_path, '/'), lambda x: x <> ''), lambda x: translate(lower(x), ' -', '__'))"
_AUDITED = {
    **more._MASK_VIEWS,
    "told": f"""SELECT image_id, image_path, stem, wanted, {more._category_of("image_path")} AS category,
      CASE WHEN len(list_intersect({_TOKENS}, {C.NORMAL_SEGMENTS!r})) > 0 THEN 'normal' WHEN len(list_intersect({_TOKENS}, {C.ANOMALOUS_SEGMENTS!r})) > 0 THEN 'anomalous' END AS condition FROM wanted""",
    "found": """SELECT t.*, CASE WHEN t.condition = 'anomalous' THEN coalesce(m.path, f.path) END AS mask FROM told t LEFT JOIN masks m ON m.path = t.wanted
      LEFT JOIN (SELECT category, stem, min(path) AS path FROM placed_masks GROUP BY 1, 2) f ON f.category = t.category AND f.stem = t.stem WHERE t.category IS NOT NULL AND t.condition IS NOT NULL""",
}


@query(_all(
    _sql("image", "found", "image_id", "concat_ws('|', category, condition, mask)"), _sql("error", "told", "image_id", "'could not classify ' || coalesce(image_path, '')", tail="WHERE category IS NULL OR condition IS NULL"),
    _sql("csv", "img", "'object,set,label,image,mask'", n="count(*)"), _sql("missing_category", f"(SELECT unnest({V.CATEGORIES!r}) AS c)", "c", tail="WHERE c NOT IN (SELECT category FROM found)"),
    _sql("summary", "found", "'anomalous_without_mask'", n="count(*) FILTER (condition = 'anomalous' AND mask IS NULL)"), *_counted_sql("found", _AUDIT_DIMS),
), **_AUDITED)
def pipe_audit(spark, d):
    """The manifest with the masks of anomalous images, paths that tell no category or condition, the inventory of annotation files and the summary."""
    path = F.col("image_path")
    rows = images(spark, d, "image_id", "image_path").select("image_id", "image_path", C.find_category(path).alias("category"), C.infer_condition(path).alias("condition"), F.regexp_extract(path, more._STEM, 1).alias("stem"), C.candidate_mask(path).alias("wanted"))
    rows = cut_lineage(rows, "classified")
    known = F.col("category").isNotNull() & F.col("condition").isNotNull()
    found = cut_lineage(J.with_masks(rows.filter(known), more._masks(spark, d)).withColumn("mask", F.when(F.col("condition") == "anomalous", F.col("mask"))), "masked")
    lost = _part(rows.filter(~known), "error", F.col("image_id"), F.concat(F.lit("could not classify "), F.coalesce("image_path", F.lit(""))))
    inventory = readers.csv_inventory(spark, round_trips._annotation_files(spark, d)).groupBy("header").agg(F.sum("data_rows").alias("n"))
    expected = spark.createDataFrame([(c,) for c in V.CATEGORIES], "category string")
    missing = _part(expected.join(found, "category", "left_anti"), "missing_category", F.col("category"))
    bare = _part(found.filter("condition = 'anomalous' AND mask IS NULL").agg(F.count("*").alias("n")), "summary", F.lit("anomalous_without_mask"), None, F.col("n"))
    manifest = _part(found, "image", F.col("image_id"), F.concat_ws("|", "category", "condition", "mask"))
    return _parts(manifest, lost, _part(inventory, "csv", F.col("header"), None, F.col("n")), missing, bare, _counted(found, _AUDIT_DIMS))


_FIELDS = ["image_id", "category", "condition", "defect_type", "source_split", "image_path", "mask_path"]
_FIRSTS = {
    **K._RECORD_VIEWS,
    "by_id": "SELECT *, image_id IS NOT NULL AND (file, row_number) > min((file, row_number)) OVER (PARTITION BY image_id) AS twice FROM parsed_rows WHERE error IS NULL",
    "by_path": "SELECT *, CASE WHEN twice THEN 'image_id' WHEN image_path IS NOT NULL AND (file, row_number) > min(CASE WHEN NOT twice THEN (file, row_number) END) OVER (PARTITION BY image_path) THEN 'image_path' END AS duplicate_of FROM by_id",
    "good": "SELECT * FROM by_path WHERE duplicate_of IS NULL",
}


@query(_all(
    _sql("record", "good", "image_id", f"concat_ws('|', {', '.join(_FIELDS)})"), _sql("error", "parsed_rows", "concat_ws('#', file, row_number)", "error", tail="WHERE error IS NOT NULL"),
    _sql("error", "by_path", "concat_ws('#', file, row_number)", "'duplicate ' || duplicate_of", tail="WHERE duplicate_of IS NOT NULL"), _sql("report", "good", "'valid_records'", n="count(*)"),
    _sql("report", "parsed_rows", "'invalid_records'", n="count(*) - (SELECT count(*) FROM good)"), _sql("report", "good", "'records_with_masks'", n="count(mask_path)"), *_counted_sql("good", ["category", "condition", "source_split"], "report"),
), **_FIRSTS)
def pipe_parse(spark, d):
    """Annotation rows as records, errors and the report; a later row with a taken id or path is an error, too."""
    rows = cut_lineage(K.prj_row_to_record(spark, d), "rows")
    valid, dead = C.split_errors(rows)
    checked = cut_lineage(C.first_wins(valid, ["image_id", "image_path"], ["file", "row_number"]), "checked")
    good, twice = checked.filter("duplicate_of IS NULL"), checked.filter("duplicate_of IS NOT NULL")
    at = F.concat_ws("#", "file", "row_number")
    problems = cut_lineage(_parts(_part(dead, "error", at, F.col("error")), _part(twice, "error", at, F.concat(F.lit("duplicate "), "duplicate_of"))), "problems")
    totals = _parts(_part(good.agg(F.count("*").alias("n")), "report", F.lit("valid_records"), None, F.col("n")), _part(problems.agg(F.count("*").alias("n")), "report", F.lit("invalid_records"), None, F.col("n")), _part(good.agg(F.count("mask_path").alias("n")), "report", F.lit("records_with_masks"), None, F.col("n")))
    return _parts(_part(good, "record", F.col("image_id"), F.concat_ws("|", *_FIELDS)), problems, totals, _counted(good, ["category", "condition", "source_split"], "report"))


_GEOMETRY = {
    "f": K._FEATURES,
    "derived": f"""SELECT image_id, area, ratio, round(cx, 6) AS x, round(cy, 6) AS y, {V.LOCATIONS!r}[CAST(least(floor(cy / 8 * 3), 2) * 3 + least(floor(cx / 8 * 3), 2) AS INT) + 1] AS cell,
      CASE WHEN ratio < {V.MINOR_BELOW} THEN 'minor' WHEN ratio < {V.MODERATE_BELOW} THEN 'moderate' ELSE 'major' END AS severity FROM f""",
}


@query(_all(
    _sql("record", "derived", "image_id", "concat_ws('|', cell, severity, area)", "area"), _sql("error", "(SELECT DISTINCT image_id FROM pix)", "image_id", "'mask without foreground'", tail="WHERE image_id NOT IN (SELECT image_id FROM f)"),
    _sql("report", "derived", "'records'", n="count(*)"), *_counted_sql("derived", ["cell", "severity"], "report"),
), **_GEOMETRY)
def pipe_features(spark, d):
    """Geometry, grid cell and severity of every mask, masks without foreground as errors, and the report."""
    none = F.lit(None).cast("string")
    f = K._features(spark, d).select("image_id", "area", geometry.nine_grid("x_normalized", "y_normalized").alias("cell"), geometry.severity("ratio", none).alias("severity"))
    f = cut_lineage(f, "features")
    empty = K.pixels(spark, d).select("image_id").distinct().join(f, "image_id", "left_anti")
    report = _part(f.agg(F.count("*").alias("n")), "report", F.lit("records"), None, F.col("n"))
    return _parts(_part(f, "record", F.col("image_id"), F.concat_ws("|", "cell", "severity", "area"), F.col("area")), _part(empty, "error", F.col("image_id"), F.lit("mask without foreground")), report, _counted(f, ["cell", "severity"], "report"))


# splits and instructions


_SPLIT_DIMS = {"category": "category", "condition": "condition", "category_condition": "concat_ws('/', category, condition)", "defect": "CASE WHEN condition = 'anomalous' THEN coalesce(defect_type, 'unspecified_anomaly') END", "visual_severity": "visual_severity"}
_WITH_SPLIT = SQL["win_contiguous_assign"]
_BODY = "SELECT image_id, coalesce('sha256:' || sha256, 'id:' || image_id) AS cluster, split FROM img JOIN con"
_SPLIT_SQL = _all(
    _sql("assignment", "asg", "image_id", "split"),
    *(_sql(f"leak:{k}", f"(SELECT {k} AS k, split FROM asg WHERE {k} IS NOT NULL)", "k", "array_to_string(list_sort(list(DISTINCT split)), ',')", tail="GROUP BY k HAVING count(DISTINCT split) > 1") for k in ("image_id", "image_path", "sha256")),
    *(_sql(f"duplicate:{k}", "asg", k, n="count(*)", tail=f"WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1") for k in ("image_id", "image_path")),
    _sql("warning:strata", "(SELECT coalesce('sha256:' || sha256, 'id:' || image_id) AS cluster, min_by(image_id, (ingested_at, image_id)) AS first, count(DISTINCT concat_ws('|', category, condition)) AS strata FROM img GROUP BY 1)", "cluster", "first", "strata", "WHERE strata > 1"),
    *(
        f"""SELECT 'count' AS part, s.split || ':{k}' AS key, c.value, coalesce(c.n, 0) AS n FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s
            LEFT JOIN (SELECT split, CAST({v} AS VARCHAR) AS value, count(*) AS n FROM asg GROUP BY ALL) c USING (split){" WHERE c.value IS NOT NULL OR c.n IS NULL" if k == "defect" else ""}"""
        for k, v in _SPLIT_DIMS.items()
    ),
)


@query()
def pipe_split(spark, d):
    """Assignments, the counts of each split, warnings and leaks."""
    i = cut_lineage(images(spark, d, "image_id", "category", "condition", "defect_type", "visual_severity", "image_path", "sha256", "ingested_at"), "images")
    rows = cut_lineage(i.join(S.assign_splits(i, "ingested_at", SEED).select("image_id", "split"), "image_id", "left"), "assigned")
    leaks = [_part(A.cross_split_leaks(rows, k, "split"), f"leak:{k}", F.col("key"), F.col("splits")) for k in ("image_id", "image_path", "sha256")]
    repeats = [_part(A.repeated(rows, k), f"duplicate:{k}", F.col("value"), None, F.col("n")) for k in ("image_id", "image_path")]
    spans = _part(S.duplicate_clusters(i, "ingested_at").filter("strata > 1"), "warning:strata", F.col("cluster"), F.col("image_id"), F.col("strata"))
    defect = F.when(F.col("condition") == "anomalous", F.coalesce("defect_type", F.lit("unspecified_anomaly")))
    wide = rows.withColumns({"category_condition": F.concat_ws("/", "category", "condition"), "defect": defect})
    stats = A.split_stats(wide, "split", list(_SPLIT_DIMS), S.SPLITS).filter("dim <> 'defect' OR value IS NOT NULL OR n = 0")
    stats = _part(stats, "count", F.concat_ws(":", "split", "dim"), F.col("value"), F.col("n"))
    lost = _part(rows.filter("split IS NULL"), "unassigned", F.col("image_id"))
    return _parts(_part(rows.filter("split IS NOT NULL"), "assignment", F.col("image_id"), F.col("split")), *leaks, *repeats, spans, stats, lost)


_at = _WITH_SPLIT.index(_BODY)
SQL["pipe_split"] = _WITH_SPLIT[:_at].rstrip() + ",\nasg AS (SELECT img.*, con.split FROM img JOIN con ON con.cluster = coalesce('sha256:' || sha256, 'id:' || image_id))\n" + _SPLIT_SQL


@query()
def pipe_instructions(spark, d):
    """Chat records of all images, with the split of their images."""
    pictures = cut_lineage(images(spark, d, "image_id", "category", "condition", "defect_type", "nine_grid_location", "visual_severity", "anomaly_area_ratio", "image_path", "sha256", "ingested_at"), "images")
    rows = J.template_cross(pictures, K._templates(spark), 3, 20).join(S.assign_splits(pictures, "ingested_at", SEED).select("image_id", "split"), "image_id")
    said = F.lit(None).cast("string")
    for name, c in answers.answers().items():
        said = F.when(F.col("kind") == name, c).otherwise(said)
    part = lambda t, image, words: F.struct(F.lit(t).alias("type"), image.cast("string").alias("image"), words.cast("string").alias("text"))
    none = F.lit(None)
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", F.col("image_path"), none), part("text", none, F.col("prompt"))).alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, said)).alias("content"))
    tags = F.concat(F.array(F.lit("image_level_label"), F.lit("product_category")), F.when(F.col("condition") == "anomalous", F.array(F.lit("defect_label"), F.lit("segmentation_mask"), F.lit("derived_spatial_features"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.concat_ws("__", "image_id", "template_id").alias("instruction_id"), "image_id", "split", "task_family", "template_id", F.array(user, assistant).alias("messages"), "category", "condition", "defect_type", F.col("nine_grid_location").alias("location"), "visual_severity", "answer_format", tags.alias("grounded_by"))


# readiness


@query(_all(
    _sql("problem", "problems", "task_family", "problem", "count(*)", "GROUP BY ALL"),
    _sql("split_leak", "(SELECT image_id, split FROM rec WHERE image_id IS NOT NULL AND split IS NOT NULL)", "image_id", "array_to_string(list_sort(list(DISTINCT split)), ',')", tail="GROUP BY image_id HAVING count(DISTINCT split) > 1"),
    _sql("duplicate_id", f"(SELECT {id_sql('instruction_id')} AS id FROM instructions)", "id", n="count(*)", tail="WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"),
    _sql("statistic", "rec", "'records'", n="count(*)"), *(_sql("statistic", "rec", f"'{k}'", n=f"count(DISTINCT {c})") for k, c in (("prompts", "prompt"), ("answers", "answer"), ("images", "image_id"))),
    *_counted_sql("rec", ["split", "task_family", "category", "condition", "answer_format"]),
    _sql("gallery", "(SELECT instruction_id, task_family, row_number() OVER (PARTITION BY task_family ORDER BY sha256('42:' || instruction_id), instruction_id) AS r FROM rec WHERE task_family IS NOT NULL)", "instruction_id", "task_family", tail="WHERE r <= 4"),
), **K._PROBLEM_VIEWS)
def pipe_readiness(spark, d):
    """Problems of records by kind and task, images in several splits, repeated identifiers, statistics of texts and images, counts, and the gallery."""
    found = _part(K._record_problems(spark, d).groupBy("task_family", "problem").agg(F.count("*").alias("n")), "problem", F.col("task_family"), F.col("problem"), F.col("n"))
    r = records(spark, d, "instruction_id", "image_id", "split", "task_family", "category", "condition", "answer_format", "prompt", "answer")
    # texts are only counted, so their digests go on
    r = cut_lineage(r.withColumns({"prompt": F.when(F.col("prompt").isNotNull(), F.sha2("prompt", 256)), "answer": F.when(F.col("answer").isNotNull(), F.sha2("answer", 256))}), "records")
    leaks = _part(A.cross_split_leaks(r, "image_id", "split"), "split_leak", F.col("key"), F.col("splits"))
    twice = _part(A.repeated(table(spark, d, "instructions").select(text.canonical_id("instruction_id").alias("i")), "i"), "duplicate_id", F.col("value"), None, F.col("n"))
    one = r.agg(F.count("*").alias("records"), F.count_distinct("prompt").alias("prompts"), F.count_distinct("answer").alias("answers"), F.count_distinct("image_id").alias("images"))
    stats = _part(one.selectExpr("stack(4, 'records', records, 'prompts', prompts, 'answers', answers, 'images', images) AS (k, v)"), "statistic", F.col("k"), None, F.col("v"))
    shown = r.filter("task_family IS NOT NULL").select("instruction_id", "task_family")
    shown = S.quota_sample(shown, shown.select("task_family").distinct().withColumn("quota", F.lit(4).cast("bigint")), "task_family", "instruction_id", SEED)
    return _parts(found, leaks, twice, stats, _counted(r, ["split", "task_family", "category", "condition", "answer_format"]), _part(shown, "gallery", F.col("instruction_id"), F.col("task_family")))


# benchmark


_BENCH_COLUMNS = ["instruction_id", "image_id", "task_family", *S.STRATUM]


def _benchmark(spark, d):
    rows = cut_lineage(records(spark, d, *_BENCH_COLUMNS, "split").filter("split = 'test' AND task_family IS NOT NULL AND image_id IS NOT NULL").select(*_BENCH_COLUMNS), "test")
    return rows, cut_lineage(S.unique_first_round_robin(rows, K._quotas(spark), SEED), "benchmark")


def _digest(df):
    return A.corpus_fingerprint(df.withColumn("__all", F.lit(1)), "instruction_id", ["__all"])


_BENCH_VIEWS = {
    "tst": K._TEST, "q": K._QUOTA, "u": K._UFR,
    "sampled": "SELECT t.*, u.rank FROM u JOIN tst t USING (instruction_id) WHERE u.rank <= u.quota",
    "filled": "SELECT * REPLACE (coalesce(location, 'none') AS location, coalesce(defect_type, 'none') AS defect_type, coalesce(category, 'none') AS category, coalesce(condition, 'none') AS condition, coalesce(visual_severity, 'none') AS visual_severity) FROM sampled",
    "sp": X.corpus_print("(SELECT 1 AS one, instruction_id FROM tst WHERE image_id IS NOT NULL)", "one"), "bp": X.corpus_print("(SELECT 1 AS one, instruction_id FROM sampled)", "one"),
}


@query(_all(
    _sql("sample", "sampled", "instruction_id", "task_family", "rank"), _sql("manifest", "sp", "'source_sha256'", "fingerprint", "n"), _sql("manifest", "bp", "'benchmark_sha256'", "fingerprint", "n"),
    _sql("manifest", "sampled", "'unique_images'", n="count(DISTINCT image_id)"), *_counted_sql("filled", ["task_family", *S.STRATUM]), _sql("target", "q", "task_family", n="quota"),
), **_BENCH_VIEWS)
def pipe_benchmark(spark, d):
    """The sample, and its manifest: digests of it and its source, and its distribution."""
    rows, taken = _benchmark(spark, d)
    digests = [_part(_digest(df), "manifest", F.lit(f"{k}_sha256"), F.col("fingerprint"), F.col("n")) for k, df in (("source", rows), ("benchmark", taken))]
    images_ = _part(taken.agg(F.count_distinct("image_id").alias("n")), "manifest", F.lit("unique_images"), None, F.col("n"))
    filled = taken.fillna("none", S.STRATUM)
    return _parts(_part(taken, "sample", F.col("instruction_id"), F.col("task_family"), F.col("rank")), *digests, images_, _counted(filled, ["task_family", *S.STRATUM]), _part(K._quotas(spark), "target", F.col("task_family"), None, F.col("quota")))


@query()
def pipe_benchmark_validate(spark, d):
    """All problems of the benchmark's deliveries against what was frozen, its images and quotas, and what it holds."""
    _, taken = _benchmark(spark, d)
    token = text.canonical_token
    lines = table(spark, d, "instructions").select(text.canonical_id("instruction_id").alias("instruction_id"), text.canonical_split("dataset_split").alias("split"), token("task_family").alias("task_family"), token("image_id").alias("image_id"), C.message_fields()["image"].alias("image"), token("metadata.category").alias("category"), token("metadata.condition").alias("condition"), token("metadata.visual_severity").alias("visual_severity"))
    lines = cut_lineage(lines.join(taken.select("instruction_id"), "instruction_id", "left_semi"), "lines")
    quotas = K._quotas(spark).withColumnRenamed("quota", "n")
    problems = C.benchmark_problems(lines, quotas, images(spark, d, "image_id", "width", "height"), _digest(taken))
    sets = lines.groupBy("task_family").agg(*(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in ("category", "condition")))
    found = [_part(sets, f"{c}_by_task", F.col("task_family"), F.col(c)) for c in ("category", "condition")]
    return _parts(_part(problems, "error", F.concat_ws(":", "error", "key"), F.col("detail")), _counted(lines, ["task_family", "category", "condition", "visual_severity"]), *found)


# evaluation


def _evaluation(rows, tests, answered):
    """All that an evaluation writes: (part, scope, metric, label, said, value, text)."""
    none = F.lit(None).cast("string")
    line = lambda df, part, scope, metric, value=None, label=none, said=none, words=none: df.select(F.lit(part).alias("part"), scope.cast("string").alias("scope"), metric.alias("metric"), label.alias("label"), said.alias("said"), (F.lit(None) if value is None else F.round(value, 6)).cast("double").alias("value"), words.alias("text"))
    task = line(E.task_metrics(rows), "task", F.col("task_family"), F.col("metric"), F.col("value"), F.col("label"), F.col("said"))
    rollup = E.category_rollup(rows).selectExpr("category", "stack(4, 'count', double(n), 'failure_rate', failure_rate, 'unsupported_root_cause_rate', root_cause_rate, 'unsupported_safety_claim_rate', safety_claim_rate) AS (metric, value)")
    category = line(rollup, "category", F.col("category"), F.col("metric"), F.col("value"))
    tags = line(E.overall(rows), "overall", F.lit("all"), F.col("tag"), F.col("n"))
    totals = [line(df.agg(F.count("*").alias("n")), "overall", F.lit("all"), F.lit(k), F.col("n")) for k, df in (("benchmark_records", tests), ("predictions", answered))]
    both = J.coverage(tests, answered, "instruction_id").groupBy("side").agg(F.count("*").alias("n"))
    covered = line(both, "overall", F.lit("all"), F.col("side"), F.col("n"))
    failures = line(rows.filter(F.size("tags") > 0), "failure", F.col("prediction_no"), F.array_join("tags", ","), None, F.col("task_family"), F.col("category"), F.sha2("prediction", 256))
    unparsed = line(E.unparsed_rows(rows), "parsing_error", F.col("prediction_no"), F.col("task_family"))
    return reduce(lambda a, b: a.unionByName(b), [task, category, tags, *totals, covered, failures, unparsed])


def _evaluation_sql(tests: str) -> str:
    line = lambda part, table_, scope, metric, value="NULL", label="NULL", said="NULL", words="NULL", tail="": f"SELECT '{part}' AS part, CAST({scope} AS VARCHAR) AS scope, {metric} AS metric, CAST({label} AS VARCHAR) AS label, CAST({said} AS VARCHAR) AS said, round(CAST({value} AS DOUBLE), 6) AS value, CAST({words} AS VARCHAR) AS text FROM {table_} {tail}"
    rates = {"count": "count(*)", "failure_rate": "avg((len(tags) > 0)::INT)", "unsupported_root_cause_rate": "avg(unsupported_root_cause::INT)", "unsupported_safety_claim_rate": "avg(unsupported_safety_claim::INT)"}
    return _all(
        line("task", "tm", "task_family", "metric", "value", "label", "said"), *(line("category", "ev", "category", f"'{k}'", v, tail="GROUP BY category") for k, v in rates.items()),
        line("overall", f"({X.TAGS})", "'all'", "tag", "n"), line("overall", tests, "'all'", "'benchmark_records'", "count(*)"), line("overall", "pred", "'all'", "'predictions'", "count(*)"),
        *(line("overall", f"(SELECT count(*) AS n FROM (SELECT DISTINCT instruction_id FROM {a} WHERE instruction_id NOT IN (SELECT instruction_id FROM {b})))", "'all'", f"'{side}'", "n", tail="WHERE n > 0") for side, a, b in (("missing", tests, "pred"), ("extra", "pred", tests))),
        line("failure", "ev", "prediction_no", "array_to_string(tags, ',')", label="task_family", said="category", words="sha256(prediction)", tail="WHERE len(tags) > 0"), line("parsing_error", f"({X.UNPARSED})", "prediction_no", "task_family"),
    )


@query(_evaluation_sql("tests"), **X.TASK_VIEWS, tests="SELECT instruction_id FROM rec WHERE split = 'test'")
def pipe_evaluate(spark, d):
    """Metrics of every task with those of its labels and their confusion, the category rollup, totals, tags and coverage, failures and parsing errors."""
    tests = records(spark, d, "instruction_id", "split").filter("split = 'test'").select("instruction_id")
    return _evaluation(K._evaluated(spark, d), tests, predictions(spark, d, "run_id", "instruction_id"))


_ADAPTER = "SELECT delivery_id AS prediction_no, 'adapter' AS run_id, instruction_id, image_id, task_family, category, condition, defect_type, location, visual_severity, answer AS prediction FROM rec WHERE split = 'test'"


@query("SELECT * FROM tm", **({"made": _ADAPTER} | X.TASK_VIEWS | X.views_of("made")))
def pipe_adapter_eval(spark, d):
    """Predictions of a stand-in model, which repeats the answer of every test record, and their metrics; loading a model is out of scope."""
    tests = records(spark, d, "delivery_id", "instruction_id", "image_id", "task_family", "category", "condition", "defect_type", "location", "visual_severity", "answer", "split").filter("split = 'test'")
    rows = cut_lineage(tests.drop("split").withColumnsRenamed({"delivery_id": "prediction_no", "answer": "prediction"}), "tests")
    return E.task_metrics(cut_lineage(E.evaluated(E.parsed(rows)), "evaluated")).withColumn("value", F.round("value", 6))


@query(X.FAILURE_SQL, **X.FAILURE_VIEWS)
def pipe_failure_analysis(spark, d):
    """Counts, errors and ranked confusions of defects and locations: the report of ``failure_analysis`` over all predictions."""
    return E.failure_analysis(K._evaluated(spark, d))


# selections


_SELECTED = "SELECT * FROM (SELECT f.*, b.quota, row_number() OVER (PARTITION BY task_family ORDER BY is_floor DESC, score DESC, sha256('42:' || instruction_id)) AS r FROM flo f JOIN b USING (task_family)) WHERE r <= quota"
_SELECTED_VIEWS = X.HARD_VIEWS | {"flo": K._FLOORS, "b": K._BIG, "sel": _SELECTED}


def _selected(spark, d):
    quotas = spark.createDataFrame(list(K._BIGS.items()), "task_family string, quota bigint")
    return S.floor_then_fill(K._hard(spark, d), quotas, SEED, 2)


@query("SELECT instruction_id, task_family, condition, category, score, is_floor FROM sel", **_SELECTED_VIEWS)
def pipe_hard_examples(spark, d):
    """Training records chosen by the mistakes on validation predictions."""
    return _selected(spark, d)


@query(_all(
    _sql("record", "sel", "instruction_id", "task_family", "score"), _sql("manifest", "(" + X.corpus_print("(SELECT 1 AS one, instruction_id FROM sel)", "one") + ")", "'selection_sha256'", "fingerprint", "n"),
    _sql("manifest", "sel", "'floors'", n="count(*) FILTER (is_floor)"), _sql("manifest", "sel", "'weighed'", n="count(*) FILTER (score > 0)"), _sql("manifest", "hard", "'pool'", n="count(*)"),
    *_counted_sql("sel", ["task_family", "condition", "category"]), _sql("quota", "b", "task_family", n="quota"), _sql("weight", "wd", "concat_ws(':', kind, category, item)", n="w"),
), **_SELECTED_VIEWS)
def win_hard_select(spark, d):
    """The selection of hard examples with its audit and manifest: digest, floors, weighed records, pool, counts, quotas and the weights that it followed."""
    quotas = spark.createDataFrame(list(K._BIGS.items()), "task_family string, quota bigint")
    weights = K._mistakes(spark, d)
    pool = K._hard(spark, d, weights)
    taken = cut_lineage(S.floor_then_fill(pool, quotas, SEED, 2), "selected")
    one = lambda name, df, c: _part(df.agg(c.alias("n")), "manifest", F.lit(name), None, F.col("n"))
    digest = _part(_digest(taken), "manifest", F.lit("selection_sha256"), F.col("fingerprint"), F.col("n"))
    facts = [one("floors", taken, F.count_if("is_floor")), one("weighed", taken, F.count_if(F.col("score") > 0)), one("pool", pool, F.count("*"))]
    return _parts(_part(taken, "record", F.col("instruction_id"), F.col("task_family"), F.col("score")), digest, *facts, _counted(taken, ["task_family", "condition", "category"]), _part(quotas, "quota", F.col("task_family"), None, F.col("quota")), _part(weights, "weight", F.concat_ws(":", "kind", "category", "item"), None, F.col("w")))


@query(SQL["agg_selection_audit"])
def pipe_selection_audit(spark, d):
    """The audit of all training runs' selections."""
    return more.agg_selection_audit(spark, d)


# release


_GATES = SQL["prj_threshold_gate"]
_GATE_AT = _GATES.index("SELECT name, kind, bound, value, CASE WHEN")
_RUNS = """SELECT 'run:' || r.run_id AS name, CASE WHEN NOT coalesce(p.most <= r.max_new_tokens, true) THEN 'fail' WHEN p.run_id IS NULL THEN 'pending' ELSE 'pass' END AS status
  FROM inference_runs r LEFT JOIN (SELECT run_id, max(generated_token_count) AS most FROM pred GROUP BY 1) p ON r.run_id = p.run_id"""
_CHECKS = f"SELECT 'threshold:' || name AS name, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status FROM ({_GATES[_GATE_AT:]}) UNION ALL {_RUNS}"
_STATES = _all(
    _sql("check", "checks", "name", "status"), *(_sql("count", "checks", f"'{s}'", n=f"count(*) FILTER (status = '{s}')") for s in ("pass", "pending", "fail")),
    _sql("state", "checks", "CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'blocked' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'pending' ELSE 'ready' END"),
)


@query()
def pipe_release(spark, d):
    """The checks of thresholds and of each run's contract with their status, their counts, and the state: ready, pending or blocked."""
    gates = K.prj_threshold_gate(spark, d).select(F.concat(F.lit("threshold:"), "name").alias("name"), F.when(F.col("passed"), "pass").otherwise("fail").alias("status"))
    runs = more.join_manifest_check(spark, d).select(F.concat(F.lit("run:"), "run_id").alias("name"), F.when(~F.col("within"), "fail").when(~F.col("predicted"), "pending").otherwise("pass").alias("status"))
    checks = cut_lineage(gates.unionByName(runs), "checks")
    state = C.release_status(checks)
    return _parts(_part(checks, "check", F.col("name"), F.col("status")), *(_part(state, "count", F.lit(k), None, F.col(k)) for k in ("pass", "pending", "fail")), _part(state, "state", F.col("state")))


SQL["pipe_release"] = _GATES[:_GATE_AT].rstrip() + f",\nchecks AS ({_CHECKS})\n" + _STATES
