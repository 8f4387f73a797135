import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import aggregates as A
from sightline.operators import joins as J
from sightline.operators import metrics as M
from sightline.operators import sampling as S
from sightline.operators import validate as C
from sightline.operators.ranking import bottom_k, running_sum


def test_bottom_k_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), round(rng.random(), 2), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, key double, i int").withColumn("k", F.when(F.col("g") == "a", 700).otherwise(10**9))
    for parts, buckets in ((1, 16), (7, 4096)):
        got = bottom_k(df.repartition(parts), ["g"], "key", ["i"], "k", buckets).collect()
        a = sorted((r[1], r[2]) for r in rows if r[0] == "a")[:700]
        assert sorted((r.key, r.i) for r in got if r.g == "a") == a
        assert sum(r.g == "b" for r in got) == sum(r[0] == "b" for r in rows)


def test_bottom_k_limits(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 2)], "g string, key double, i int")
    for k, n in ((0, 0), (-3, 0), (1, 1), (2, 2), (9, 2), (None, 2)):
        assert bottom_k(df.withColumn("k", F.lit(k).cast("bigint")), ["g"], "key", ["i"], "k").count() == n
    assert bottom_k(df.filter("false").withColumn("k", F.lit(3)), ["g"], "key", ["i"], "k").count() == 0


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.random(), i, rng.randrange(5)) for i in range(500)]
    got = running_sum(spark.createDataFrame(rows, "g string, key double, i int, v bigint"), ["g"], "key", ["i"], "v", "before", 8).collect()
    for r in got:
        assert r.before == sum(v for g, key, i, v in rows if g == r.g and (key, i) < (r.key, r.i))


def test_classification(spark):
    df = spark.createDataFrame([("normal", "normal"), ("anomalous", None)], "t string, p string")
    row = M.classification_overall(df, "t", "p").first()
    assert (row["count"], row.accuracy, row.unparsed, row.macro_f1) == (2, 0.5, 1, 0.5)
    assert M.classification_overall(df.filter("false"), "t", "p").first().accuracy == 0.0
    said = {r.label: r for r in M.classification_by_label(spark.createDataFrame([("a", "b"), ("a", "a")], "t string, p string"), "t", "p").collect()}
    assert said["b"].support == 0 and said["b"].fp == 1 and said["a"].recall == 0.5


def test_sets_and_neighbours(spark):
    df = spark.createDataFrame([(["bubble", "scratch"], ["scratch"]), ([], []), ([], ["a"])], "t array<string>, p array<string>")
    got = df.select(*(c.alias(k) for k, c in M.set_scores("t", "p").items())).collect()
    assert (got[0].precision, got[0].recall, got[0].exact_match) == (1.0, 0.5, False)
    assert (got[1].f1, got[1].exact_match, got[2].f1, got[2].precision) == (1.0, True, 0.0, 0.0)
    near = spark.createDataFrame([("top_left", "center"), ("top_left", "top_right"), ("center", None), ("x", "center"), ("center", "center")], "t string, p string")
    assert [r[0] for r in near.select(M.adjacent("t", "p")).collect()] == [True, False, False, False, True]


def test_percentiles(spark):
    import statistics

    rng = random.Random(3)
    for n in (1, 2, 11, 20, 101):
        xs = [rng.randrange(-5, 50) for _ in range(n)]
        row = A.percentiles(spark.createDataFrame([(x,) for x in xs] + [(None,)], "v bigint"), "v").first()
        s = sorted(xs)
        assert (row["count"], row.min, row.median, row.max) == (n, s[0], statistics.median(s), s[-1])
        assert [row.p90, row.p95, row.p99] == [s[round((n - 1) * p)] for p in (0.9, 0.95, 0.99)]
    assert tuple(A.percentiles(spark.createDataFrame([], "v bigint"), "v").first()) == (0, 0, 0.0, 0, 0, 0, 0, 0.0)


def test_duplicates_leaks_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([("b", "train"), ("a", "test"), ("a", "train"), (None, "test")], "k string, s string")
    assert tuple(A.duplicate_summary(df, "k").first()) == (2, 1, 2, 2)
    assert [tuple(r) for r in A.cross_split_leaks(df, "k", "s").collect()] == [("a", "test,train")]
    one = A.fingerprint(df.filter("s = 'train'"), "k", ["s"]).first()
    assert one.fingerprint == hashlib.sha256(b"a\nb\n").hexdigest()
    many = df.filter("k IS NOT NULL")
    assert A.corpus_fingerprint(many, "k", ["s"]).orderBy("s").collect() == A.corpus_fingerprint(many.repartition(3), "k", ["s"]).orderBy("s").collect()
    assert df.filter("false").agg(A.all_true(F.lit(False)).alias("a"), A.any_true(F.lit(True)).alias("o")).first() == (True, False)


@pytest.mark.parametrize(("n", "want"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (3, (2, 0, 1)), (10, (7, 1, 2)), (20, (14, 3, 3)), (7, (5, 1, 1))])
def test_largest_remainder(spark, n, want):
    row = spark.createDataFrame([(n,)], "n bigint").select(*(c.alias(k) for k, c in S.largest_remainder(F.col("n")).items())).first()
    assert (row.train, row.validation, row.test) == want


def images(spark, n, twins=True):
    rows = [(f"i{k:03d}", "pcb1", "normal" if k % 3 else "anomalous", None if k % 3 else ["scratch", "hole,dust", None][k % 2], f"{k // 2 if twins and k < 8 else k:064x}" if k % 5 else None, k) for k in range(n)]
    return spark.createDataFrame(rows, "image_id string, category string, condition string, defect_type string, sha256 string, ord int")


def test_splits_keep_twins_and_repeat(spark):
    df = images(spark, 60)
    a = {r.image_id: (r.cluster, r.split) for r in S.assign_splits(df, "ord").collect()}
    b = {r.image_id: (r.cluster, r.split) for r in S.assign_splits(df.repartition(7), "ord").collect()}
    assert a == b and len(a) == 60
    by = {}
    for cluster, split in a.values():
        assert by.setdefault(cluster, split) == split
    assert set(by.values()) == {"train", "validation", "test"}
    assert S.assign_splits(df.filter("false"), "ord").count() == 0


def test_round_robin_is_a_loop(spark):
    import hashlib

    df = images(spark, 40, twins=False)
    got = {r.image_id: r.position for r in S.defect_round_robin(df, 7, "image_id").filter("condition = 'anomalous'").collect()}
    h = lambda x: hashlib.sha256(f"7:{x}".encode()).hexdigest()
    buckets = {}
    for r in df.filter("condition = 'anomalous'").collect():
        buckets.setdefault(r.defect_type or "unspecified_anomaly", []).append(r.image_id)
    order = sorted(buckets, key=lambda k: (-len(buckets[k]), h(k)))
    for v in buckets.values():
        v.sort(key=h, reverse=True)
    turn, out = 0, []
    while any(buckets.values()):
        out += [buckets[k].pop() for k in order if buckets[k]]
        turn += 1
    assert [x for x, _ in sorted(got.items(), key=lambda x: x[1])] == out


def records(spark, n=48):
    rows = [(f"r{i:03d}", f"img{i // 4}", ["a", "b"][i % 2], "pcb1" if (i // 4) % 2 else "candle", "normal" if (i // 4) % 3 else "anomalous", None, None, "none", i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "instruction_id string, image_id string, task_family string, category string, condition string, defect_type string, location string, visual_severity string, score bigint")


def test_quota_samples(spark):
    rows, quotas = records(spark), spark.createDataFrame([("a", 5), ("b", 3)], "task_family string, quota bigint")
    one = S.quota_sample(rows, quotas, "task_family", "instruction_id", 42).collect()
    two = S.quota_sample(rows.repartition(5), quotas, "task_family", "instruction_id", 42).collect()
    assert {r.instruction_id for r in one} == {r.instruction_id for r in two} and len(one) == 8
    S.require_quotas(rows, quotas, "task_family")
    with pytest.raises(ValueError):
        S.require_quotas(rows, spark.createDataFrame([("a", 500)], "task_family string, quota bigint"), "task_family")
    assert S.limit_sample(rows, None, "instruction_id", 1).count() == 48 and S.limit_sample(rows, 7, "instruction_id", 1).count() == 7


def test_floors_then_hardest(spark):
    quotas = spark.createDataFrame([("a", 6), ("b", 10)], "task_family string, quota bigint")
    got = S.floor_then_fill(records(spark), quotas, 42, 2).collect()
    assert sum(r.task_family == "a" for r in got) == 6 and sum(r.task_family == "b" for r in got) == 10
    assert all(sum(r.is_floor and (r.task_family, r.category) == (t, c) for r in got) == 2 for t in "ab" for c in ("pcb1", "candle"))
    assert sorted((r.score for r in got if r.task_family == "a" and not r.is_floor), reverse=True)[0] == 4
    with pytest.raises(ValueError):
        S.floor_then_fill(records(spark), quotas, 42, 9)


def test_new_images_first(spark):
    quotas = spark.createDataFrame([("a", 12), ("b", 20)], "task_family string, quota bigint")
    got = S.unique_first_round_robin(records(spark), quotas, 42).collect()
    a = [r.image_id for r in sorted(got, key=lambda r: r.rank) if r.task_family == "a"]
    assert len(a) == 12 == len(set(a))
    assert len({r.image_id for r in got if r.task_family == "b"}) == 12
    again = S.unique_first_round_robin(records(spark).repartition(6), quotas, 42).collect()
    assert {(r.instruction_id, r.rank) for r in got} == {(r.instruction_id, r.rank) for r in again}


def test_shuffle_like_the_twister(spark):
    df = spark.createDataFrame([("g", i) for i in range(6)], "g string, i int")
    want = list(range(6))
    random.Random(5).shuffle(want)
    assert [r.i for r in S.shuffled_like_mt19937(df, "g", "i", 5).orderBy("position").collect()] == want
    text = S.exact_three_decimals(spark.createDataFrame([(0.0625,), (2.0005,), (None,)], "x double"), "x", "t").collect()
    assert [r.t for r in text] == ["0.062", "2.001", None]


def test_checkpoints(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, False)]
    kept = S.newest_or_best(spark.createDataFrame(rows, "location string, step int, is_best boolean"), 2).collect()
    assert sorted(r.step for r in kept) == [1, 3, 4]


def test_joins(spark):
    t, p = spark.createDataFrame([(1, 0), (2, 1)], "id int, ord int"), spark.createDataFrame([(2, "x"), (3, "y")], "id int, said string")
    assert {tuple(r) for r in J.coverage(t, p, "id").collect()} == {(1, "missing"), (3, "extra")}
    with pytest.raises(ValueError):
        J.finalize(t, p, "id", "ord")
    assert [r.id for r in J.pending(t, p, "id").collect()] == [1]
    assert [r.id for r in J.overlap(t, p, "id").collect()] == [2]
    assert J.pending(t, p.filter("false"), "id", t, retry=True).count() == 2
    masks = spark.createDataFrame([("m/b.png", "c", "b"), ("n/a.png", "c", "a"), ("m/a.png", "c", "a")], "path string, category string, stem string")
    imgs = spark.createDataFrame([("x/a.png", "c", "a"), ("m/b.png", "c", "b"), ("z", "d", "z")], "wanted string, category string, stem string")
    assert {r.stem: r.mask for r in J.with_masks(imgs, masks).collect()} == {"a": "m/a.png", "b": "m/b.png", "z": None}


def test_validation(spark):
    label = C.parse_label("x")
    df = spark.createDataFrame([("Normal",), ("bent, Melted ",), ("",), ("nan",), (None,), (",",), ("false",)], "x string")
    got = df.select(*(c.alias(k) for k, c in label.items())).collect()
    assert [r.condition for r in got] == ["normal", "anomalous", None, None, None, None, "normal"]
    assert got[1].defect_type == "bent,melted" and got[5].error is not None
    paths = spark.createDataFrame([("a/../b",), ("../x",), ("/abs",), ("C:\\x",), ("a/b",), (None,)], "p string")
    assert [r[0] for r in paths.select(C.path_contained("p")).collect()] == [True, False, False, False, True, False]
    raw = spark.createDataFrame([("/root/Data/RAW/visa/pcb1/x.jpg",), ("mydata/raw/visa/x",), ("data/raw/visa",)], "p string")
    assert [r[0] for r in raw.select(C.path_suffix("p")).collect()] == ["Data/RAW/visa/pcb1/x.jpg", None, "data/raw/visa"]
    seen = spark.createDataFrame([("r/Good/bad/a.png",), ("r/bad/a",), ("r/PCB1/a",)], "p string").select(C.infer_condition("p").alias("c"), C.find_category("p").alias("k")).collect()
    assert [r.c for r in seen] == ["normal", "anomalous", None] and seen[2].k == "pcb1"
    assert C.resolve_headers(["Image Path", "class", "LABEL", "mask"])["object"] == "class"
    with pytest.raises(ValueError):
        C.resolve_headers(["image", "mask"])


def test_rows_to_records(spark):
    schema = "file string, row_number int, folder string, object string, split string, label string, image string, mask string, defect_type string"
    rows = [
        ("f", 2, "pcb1", None, "train", "normal", "./VisA/pcb1\\1.JPG", None, None), ("f", 3, "pcb1", "pcb1", "val", "bent", "a/2.JPG", "m/2.png", None), ("f", 4, "pcb1", "pcb2", "x", "normal", "3.JPG", "", "x"),
        ("f", 5, "tray", "", None, "normal", "3.JPG", "", None), ("f", 6, "pcb1", "", None, "bent", "3.JPG", "none", None), ("f", 7, "pcb1", "", None, "", "3.JPG", None, None),
    ]
    got = {r.row_number: r for r in C.rows_to_records(spark.createDataFrame(rows, schema)).collect()}
    assert got[2].image_id == "visa_pcb1_normal_1" and got[2].error is None and got[2].image_path == "VisA/pcb1/1.JPG"
    assert got[3].source_split == "test" and got[3].defect_type == "bent"
    assert [got[i].error for i in (4, 5, 6, 7)] == ["category differs from folder", "unexpected category", "anomalous row has no mask", "label is empty"]


def test_first_wins(spark):
    rows = [(1, "a", "p"), (2, "a", "q"), (3, "b", "q"), (4, "c", "p"), (5, None, "z")]
    got = {r.n: r.duplicate_of for r in C.first_wins(spark.createDataFrame(rows, "n int, id string, path string"), ["id", "path"], ["n"]).collect()}
    assert got == {1: None, 2: "id", 3: None, 4: "path", 5: None}


def test_gates(spark):
    metrics = spark.createDataFrame([("acc", 0.5), ("err", 0.2)], "name string, value double")
    bounds = spark.createDataFrame([("acc", "min", 0.5), ("err", "max", 0.1), ("gone", "max", 1.0)], "name string, kind string, bound double")
    assert {r.name: r.passed for r in C.threshold_gate(metrics, bounds).collect()} == {"acc": True, "err": False, "gone": False}
    state = lambda *s: C.release_status(spark.createDataFrame([(x,) for x in s], "status string")).first().state
    assert (state("pass", "pending"), state("pass", "fail", "pending"), state("pass")) == ("pending", "blocked", "ready")


def test_message_rules(spark):
    from sightline.schemas import MESSAGES

    ok = [("user", [("image", "i", None), ("text", None, "q")]), ("assistant", [("text", None, "a")])]
    bad = [("user", [("text", None, "q")]), ("assistant", [("text", "i", "a")])]
    df = spark.createDataFrame([(m,) for m in (ok, bad, ok[:1], [])], f"messages {MESSAGES}")
    got = [r[0] for r in df.select(C.message_problems()).collect()]
    assert got[0] == [] and "user_parts" in got[1] and "mixed_part" in got[1] and "two_messages" in got[2] and "two_messages" in got[3]
    f = df.select(*(c.alias(k) for k, c in C.message_fields().items())).first()
    assert (f.prompt, f.image, f.answer) == ("q", "i", "a")
