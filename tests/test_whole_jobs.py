"""Jobs over whole tables, hot groups, and what plans read."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sightline.operators import aggregates as A
from sightline.operators import evaluation as E
from sightline.operators import joins as J
from sightline.operators import sampling as S
from sightline.operators import validate as C
from sightline.plans import catalog as K

DATA, QUERIES = "/root/testdata/sf0.001", queries()


def test_selection_audit_covers_train(spark):
    rows = [(split, f"{split}-{i}", f"m{i // 2}", "ab"[i % 2], "c", "normal") for split, n in (("train", 40), ("validation", 10)) for i in range(n)]
    records = spark.createDataFrame(rows, "split string, instruction_id string, image_id string, task_family string, category string, condition string")
    runs = [("limit", 42, 7, 3, None), ("all", 1, None, 99, None), ("quota", 5, 1, None, {"a": 4, "b": 2}), ("short", 5, 1, None, {"a": 21})]
    runs = spark.createDataFrame(runs, "run_id string, subset_seed bigint, train_limit bigint, validation_limit bigint, train_task_quotas map<string,bigint>")
    got = A.selection_audit(records, runs).collect()
    n = {(r.run_id, r.selection, r.kind, r.task_family, r.value): r.n for r in got}
    size = lambda run, s: n[run, s, "records", None, None]
    assert [size(r, s) for r in ("limit", "all", "quota") for s in ("train", "validation")] == [7, 3, 40, 10, 6, 10]
    assert (n["quota", "train", "task_family", None, "a"], n["quota", "train", "task_family", None, "b"], n["quota", "train", "task_category", "a", "c"]) == (4, 2, 4)
    assert n["limit", "train", "source", None, None] == 40 and n["all", "train", "images", None, None] == 20
    assert [tuple(r[:6]) for r in got if r.run_id == "short"] == [("short", "train", "short_quota", "a", "21", 20)]
    first = lambda seed, split: sorted((r[1] for r in rows if r[0] == split), key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    for split, seed, k in (("train", 42, 7), ("validation", 43, 3)):
        chosen = records.filter(records.instruction_id.isin(first(seed, split)[:k]))
        want = A.corpus_fingerprint(chosen, "instruction_id", ["split"]).first().fingerprint
        assert [r.fingerprint for r in got if (r.run_id, r.selection, r.kind) == ("limit", split, "records")] == [want]


def test_wrong_answers_and_locations_weigh(spark, monkeypatch):
    columns = "instruction_id string, split string, task_family string, category string, condition string, defect_type string, location string, visual_severity string, prediction string"
    rows = [
        ("v1", "validation", "defect_identification", "candle", "anomalous", "scratch", None, "minor", "The defect is a bubble."), ("v2", "validation", "localization", "candle", "anomalous", "scratch", "center", "minor", "top left"),
        ("v3", "validation", "defect_identification", "candle", "anomalous", "bubble", None, "minor", "The defect is a bubble."), ("t1", "train", "structured_report", "candle", "anomalous", "scratch", "center", "minor", None),
        ("t2", "train", "localization", "candle", "anomalous", "scratch", "center", "minor", None), ("t3", "train", "defect_identification", "candle", "anomalous", "bubble", "center", "minor", None), ("t4", "train", "localization", "fryum", "anomalous", "scratch", "center", "minor", None),
    ]
    all_rows = spark.createDataFrame(rows, columns)
    monkeypatch.setattr(K, "records", lambda *_: all_rows.drop("prediction"))
    monkeypatch.setattr(K, "predictions", lambda *_: all_rows.filter("prediction IS NOT NULL").drop("split").withColumns({"prediction_no": F.lit(1), "run_id": F.lit("r"), "image_id": F.lit("i")}))
    score = {r.instruction_id: r.score for r in K.QUERIES["join_weight_lookup"](spark, "").collect()}
    assert [score[f"t{i}"] for i in (1, 2, 3, 4)] == [2, 1, 0, 0]
    ranks = {r.instruction_id: r["rank"] for r in K.QUERIES["win_hard_rank"](spark, "").collect()}
    assert (ranks["t2"], ranks["t4"]) == (1, 2)
    counts = {(r.task_family, r.score): r.n for r in K.QUERIES["agg_score_histogram"](spark, "").collect()}
    assert counts == {("structured_report", 2): 1, ("localization", 1): 1, ("localization", 0): 1, ("defect_identification", 0): 1}


def test_scores_look_up_or_join(spark, monkeypatch):
    records = spark.createDataFrame([("a", "structured_report", "k", "scratch,hole", "center"), ("b", "localization", "k", "scratch", "center"), ("c", "localization", None, "scratch", None), ("d", None, "k", None, None)], "instruction_id string, task_family string, category string, defect_type string, location string")
    weights = spark.createDataFrame([("defect", "k", "scratch", 3), ("defect", "k", "hole", 1), ("location", "k", "center", 5), ("location", None, "center", 9)], "kind string, category string, item string, w bigint")
    want = {"a": 9, "b": 5, "c": 0, "d": 0}
    assert {r.instruction_id: r.score for r in E.hard_scores(records, weights).collect()} == want
    monkeypatch.setattr(E, "MAX_WEIGHTS", 0)
    assert {r.instruction_id: r.score for r in E.hard_scores(records, weights).collect()} == want


def test_one_large_score_and_many_zeros(spark):
    rows = [(f"i{i}", "t", 10**9 if i == 7 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "instruction_id string, task_family string, score bigint").withColumns({"condition": F.lit("x"), "category": F.lit("c")})
    got = {r.instruction_id: r["rank"] for r in S.hard_rank(df, 42, "task_family", 50).collect()}
    want = sorted(rows, key=lambda r: (-r[2], hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()))[:50]
    assert got == {r[0]: n for n, r in enumerate(want, 1)}


def test_percentiles_of_skewed_values(spark):
    xs = [*range(5000), 10**15]
    row = A.percentiles(spark.createDataFrame([(x,) for x in xs], "v bigint"), "v").first()
    assert (row["median"], row.p90, row.max) == (2500.0, 4500, 10**15)


def test_views_read_what_is_asked(spark):
    from sightline.plans import views

    read = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = read(QUERIES["agg_image_split_leak"](spark, DATA))
    assert "messages" not in plan and "answer" not in plan
    assert "messages" not in read(QUERIES["set_distinct"](spark, DATA)) and "prediction#" not in read(QUERIES["join_pred_inner"](spark, DATA))
    assert "messages" not in read(views.records(spark, DATA, "instruction_id", "split"))
    wide = {r.instruction_id: (r.split, r.answer) for r in views.records(spark, DATA).select("instruction_id", "split", "answer").collect()}
    assert wide == {r.instruction_id: (r.split, r.answer) for r in views.records(spark, DATA, "instruction_id", "split", "answer").collect()}


def test_percent_text_is_exact(spark):
    from sightline.functions.answers import percent_text

    rng = __import__("random").Random(3)
    xs = [0.000625, 0.000015, 0.000025, 0.1, 0.0, 1.0, 0.3195656991, *(rng.random() for _ in range(300)), *(round(rng.random() * 100, 4) / 100 for _ in range(3000)), *((2 * rng.randrange(5_000_000) + 1) / 2_000_000 for _ in range(1000))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", percent_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != f"{r.x * 100:.3f}"] == []


def test_scratch_is_dropped(spark, tmp_path):
    import pathlib

    from sightline import storage

    path = storage.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert pathlib.Path(path.removeprefix("file:")).exists() or pathlib.Path(path.removeprefix("file://")).exists()
    assert storage.drop_scratch(spark) >= 1 and not pathlib.Path(path.removeprefix("file://")).exists()


def test_order_has_no_end(spark):
    rows = [("ab"[i % 7 == 0], f"i{i * 7919 % 1000:04d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "task_family string, instruction_id string").repartition(5)
    got = {r["rank"]: (r.task_family, r.instruction_id) for r in S.ranked_in_order(df, "task_family", "instruction_id").collect()}
    assert got == dict(enumerate(sorted(rows), 1))


def test_finalize_finds_what_differs_in_any_run(spark):
    work = spark.createDataFrame([(r, i, o) for r in "ab" for o, i in enumerate("zyx")], "run_id string, instruction_id string, ordinal int")
    results = spark.createDataFrame([("a", i, "t") for i in "xyz"] + [("b", "z", "t"), ("b", "y", "t"), ("b", "q", "t")], "run_id string, instruction_id string, task_family string")
    got = [(r.run_id, r.instruction_id, r.side, r.complete) for r in J.finalize_runs(work, results, "run_id", "instruction_id", "ordinal").collect()]
    assert got[:3] == [("a", i, "both", True) for i in "zyx"]
    assert got[3:] == [("b", "z", "both", False), ("b", "y", "both", False), ("b", "x", "missing", False), ("b", "q", "extra", False)]


def test_failure_analysis_counts_all_kinds(spark):
    columns = "task_family string, category string, condition string, location string, said_location string, adjacent boolean, true_semantic array<string>, said_semantic array<string>"
    rows = [
        ("localization", "candle", "anomalous", "center", "center", True, [], []), ("localization", "candle", "anomalous", "center", "top_center", True, [], []), ("localization", "fryum", "anomalous", None, "center", False, [], []),
        ("localization", "fryum", "anomalous", None, None, False, [], []), ("defect_identification", "candle", "anomalous", None, None, False, ["scratch"], ["scratch"]), ("structured_report", "candle", "anomalous", "center", None, False, ["scratch"], []),
        ("localization", "candle", "normal", "center", None, False, [], []),
    ]
    got = E.failure_analysis(spark.createDataFrame(rows, columns)).collect()
    n = {(r.kind, r.metric, r.value): r.n for r in got if r.metric != "confusion"}
    assert [n["location", m, None] for m in ("records", "exact", "adjacent", "unparsed")] == [5, 1, 2, 2] and n["all", "records", None] == 7
    assert [n["defect", m, None] for m in ("records", "exact", "unparsed")] == [2, 1, 1]
    assert {k[2]: v for k, v in n.items() if k[:2] == ("location", "errors")} == {"candle": 2, "fryum": 2}
    assert {k[2]: v for k, v in n.items() if k[:2] == ("location", "task")} == {"localization": 4, "structured_report": 1}
    pairs = {(r.truth, r.said): (r.n, r["rank"]) for r in got if r.metric == "confusion" and r.kind == "location"}
    assert pairs["center", "center"] == (1, None) and pairs["**missing_truth**", "**unparsed**"] == (1, 1) and pairs["**missing_truth**", "center"] == (1, 2)


def test_benchmark_problems_of_all_kinds(spark):
    rows = [("i1", "test", "t", "m1", "a/1.png"), ("i1", "test", "t", "m1", "a/1.png"), ("i2", "train", "t", "m2", "a/2.png"), ("i3", "test", "u", "m3", "../3.png"), ("i4", "test", "u", "m4", "4.txt"), ("i5", "test", "u", "m5", "5.png")]
    df = spark.createDataFrame(rows, "instruction_id string, split string, task_family string, image_id string, image string")
    quotas = spark.createDataFrame([("t", 3), ("u", 9)], "task_family string, n bigint")
    pictures = spark.createDataFrame([(f"m{i}", 8, 8 * (i != 2)) for i in (1, 2, 3, 4)], "image_id string, width int, height int")
    frozen = A.corpus_fingerprint(df.withColumn("g", df.split), "instruction_id", ["g"]).limit(1)
    got = {(r.error, r.key if r.error != "digest_mismatch" else None): r.detail for r in C.benchmark_problems(df, quotas, pictures, frozen).collect()}
    assert got.pop(("digest_mismatch", None))
    assert got == {("duplicate_id", "i1"): "2", ("split_mismatch", "i2"): "train", ("task_quota", "u"): "9<>3", ("image", "m2"): "empty", ("image", "m3"): "outside the root", ("image", "m4"): "unsupported kind", ("image", "m5"): "not found"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipelines_hold_all_their_parts(spark):
    parts = lambda name: {(r.part, r.key): r.n for r in QUERIES[name](spark, DATA).groupBy("part", F.when(F.col("part").isin("report", "state", "summary"), F.col("key")).alias("key")).agg(F.sum("n").alias("n")).collect()}
    parse = parts("pipe_parse")
    assert parse["report", "valid_records"] == parse["record", None] and parse["report", "invalid_records"] == parse.get(("error", None), 0)
    assert parse["record", None] + parse.get(("error", None), 0) == K.QUERIES["prj_row_to_record"](spark, DATA).count()
    split = parts("pipe_split")
    assert split["assignment", None] == K.images(spark, DATA).count() and ("count", None) in split and not [p for p, _ in split if p.startswith("leak")]
    audit = parts("pipe_audit")
    assert audit["image", None] + audit.get(("error", None), 0) == K.images(spark, DATA).count() and ("csv", None) in audit and ("summary", "anomalous_without_mask") in audit
    assert {p for p, _ in parts("pipe_benchmark")} == {"sample", "manifest", "count", "target"}
    release = parts("pipe_release")
    assert release["check", None] == release["count", None] and len([p for p, _ in release if p == "state"]) == 1
