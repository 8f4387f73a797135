import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.grouped_split import RelatedImages, components, image_links, split_report
from sightline.llm.mixing import SourceMix
from sightline.llm.packing import best_fit, fill_report, pack, split_documents
from sightline.llm.tokens import encoding, with_tokens

IMAGE = "image_id string, sha256 string, category string, capture_session string, group_id string"
INSTRUCTION = "instruction_id string, image_id string, dataset_split string, metadata struct<category:string,condition:string>"
DIGEST = "ab" * 32


def groups_of(spark, rows, part=50_000):
    found = components(image_links(spark.createDataFrame(rows, IMAGE)), part).collect()
    return {r.image_id: r.group_id for r in found}


def test_links(spark):
    rows = [
        ("a", DIGEST, "pcb1", None, None), ("B ", DIGEST.upper(), "pcb1", "S1", None), ("c", "0" * 64, "Pcb1 ", " s1", None), ("d", "0" * 64, "pcb2", "S1", None), ("e", "xyz", None, "S1", None), (None, DIGEST, "pcb1", "S1", None),
        ("d", None, None, None, None), ("a", DIGEST, "pcb1", None, None),
    ]
    assert groups_of(spark, rows) == {"a": "a", "b": "a", "c": "a"}
    assert groups_of(spark, []) == {}


def test_long_chain_and_hot_entity(spark):
    chain = [(f"n{i:03d}", None, "k", f"s{i // 2}", None) for i in range(60)] + [(f"n{i:03d}", None, "k", f"t{(i + 1) // 2}", None) for i in range(60)]
    hot = [(f"h{i:03d}", None, "q", "one", None) for i in range(200)]
    got = groups_of(spark, chain + hot, part=16)
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] == "h"} == {"h000"}
    assert len(got) == 260


def test_random_graph_equals_union_find(spark):
    rng = random.Random(3)
    rows = [(f"i{rng.randrange(150):03d}", None, "c", f"s{rng.randrange(120)}", None) for _ in range(260)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, _, _, s, _ in rows:
        a, b = sorted((find(i), find("~" + s)))
        parent[b] = a
    got = groups_of(spark, rows)
    for i in {r[0] for r in rows}:
        assert got.get(i, i) == find(i)


def related(spark, images, instructions):
    return RelatedImages(spark.createDataFrame(images, IMAGE), spark.createDataFrame(instructions, INSTRUCTION))


def test_scattered(spark):
    images = [("a", DIGEST, "k", None, None), ("b", DIGEST, "k", "s", None), ("c", None, "k", "S ", None), ("lonely", None, "k", None, None)]
    ins = [("r1", "A", "train", None), ("r2", "c", "Testing", ("k", "normal")), ("r3", "only-here", "val", None), ("r4", "only here", "test", None), ("r5", "lonely", "train", None), ("r6", "lonely", None, None), ("r7", None, "test", None)]
    got = [r.image_id for r in related(spark, images, ins).scattered().collect()]
    assert sorted(got) == ["a", "b", "c", "only_here"]
    assert related(spark, [], []).scattered().count() == 0 and related(spark, [], []).assign().count() == 0


def test_assignment(spark):
    rng = random.Random(5)
    images = [(f"i{i}", None, f"k{i % 3}", f"s{rng.randrange(300)}", None) for i in range(900)]
    ins = [(f"r{i}-{j}", f"i{i}", "train", (f"k{i % 3}", "normal" if i % 4 else "anomalous")) for i in range(900) for j in range(3)]
    ins += [(f"big{j}", "i0", "train", ("k0", "normal")) for j in range(400)]
    r = related(spark, images, ins)
    rows = r.assign().collect()
    assert len(rows) == 900
    by: dict = {}
    for x in rows:
        assert by.setdefault(x.group_id, x.split) == x.split
    assert {x.image_id: x.split for x in r.assign().collect()} == {x.image_id: x.split for x in rows}
    share = {x.split: x.share for x in split_report(r.assign()).filter("stratum IS NULL").collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.03) and share["test"] == pytest.approx(0.15, abs=0.03)


def test_every_stratum_is_even(spark):
    rng = random.Random(6)
    kinds = [f"k{i}" for i in range(6)]
    images, ins = [], []
    for i in range(4000):
        kind = rng.choices(kinds, [40, 25, 20, 10, 4, 1])[0]
        # some sessions are shared, and some digests lie in two categories
        images.append((f"i{i}", f"{rng.randrange(1, 900):064x}" if i % 9 == 0 else None, kind, f"s{rng.randrange(2500)}" if i % 3 else None, None))
        ins += [(f"r{i}-{j}", f"i{i}", None, (kind, "normal" if i % 5 else "anomalous")) for j in range(rng.choice([1, 3, 20]))]
    ins += [(f"big{j}", "i0", "train", (images[0][2], "anomalous")) for j in range(9000)]
    r = related(spark, images, ins)
    for block in (20_000, 300):
        report = split_report(r.assign(block=block)).filter("stratum IS NOT NULL").collect()
        assert len(report) == 3 * 12 and all(x.deviation <= max(x.largest_group, 25) for x in report)
        assert all(x.share == pytest.approx(0.7 if x.split == "train" else 0.15, abs=0.02) for x in report if x.records > 2000 and x.largest_group < 1000)


def test_best_fit():
    sizes = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    bins, n = best_fit(sizes, 10)
    assert n == 3 and max(np.bincount(bins, sizes)) <= 10


def boxes(spark, sizes, capacities, **k):
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint")
    return pack(docs, spark.createDataFrame([(c,) for c in capacities], "capacity_tokens bigint"), **k)


def test_packing(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, rng.randrange(1, 900), rng.randrange(800, 5000)]) for _ in range(2000)] + [1000, 1001, 25_000, None]
    placed = boxes(spark, sizes, [1000, 4096, None, 0], task_items=300).cache()
    for cap in (1000, 4096):
        own = placed.filter(F.col("capacity_tokens") == cap)
        assert own.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= cap
        whole = {r.doc_id: r.t for r in own.groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()}
        assert whole == {i: s or 0 for i, s in enumerate(sizes)}
        assert own.groupBy("doc_id", "piece").count().filter("count > 1").count() == 0
    over = {(r.capacity_tokens, r.doc_id) for r in split_documents(placed).collect()}
    assert over == {(c, i) for c in (1000, 4096) for i, s in enumerate(sizes) if (s or 0) > c}
    assert all(r.fill > 0.97 for r in fill_report(placed).collect())
    one, two = (boxes(spark, sizes, [4096], task_items=300).repartition(n).select("container", "doc_id").collect() for n in (1, 5))
    assert sorted(one) == sorted(two)


def test_packing_edges(spark):
    assert boxes(spark, [], [10]).count() == 0 and boxes(spark, [5], []).count() == 0
    big = boxes(spark, [6] * 40, [10], task_items=7).collect()  # nothing fits together
    assert len({r.container for r in big}) == 40
    twice = pack(spark.createDataFrame([(1, 4), (1, 9), (None, 3)], "doc_id bigint, tokens bigint"), spark.createDataFrame([(10,)], "capacity_tokens bigint")).collect()
    assert [(r.doc_id, r.tokens) for r in twice] == [(1, 9)]


def mix(spark, sizes, plan, **k):
    docs = spark.createDataFrame(sizes, "doc_id bigint, source string, tokens bigint, plan_id string")
    return SourceMix(docs, spark.createDataFrame(plan, "plan_id string, source string, target_share double, max_repeats int"), **k)


def test_mixing(spark):
    sizes = [(i, ["Big ", "mid", "tiny"][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], 10, None) for i in range(2000)] + [(9000, None, 10, None), (9001, "tiny", None, None), (None, "tiny", 10, None)]
    plan = [("p", "big", 0.5, 4), ("p", "mid", 0.3, 4), ("p", "tiny", 0.15, 4), ("p", "gone", 0.05, 2), ("q", "tiny", 1.0, 2), ("q", "tiny", 0.2, 1), (None, "big", 0.1, 1)]
    m = mix(spark, sizes, plan)
    report = {(r.plan_id, r.source): r for r in m.report().collect()}
    assert {k for k, r in report.items() if r.short} == {("p", "gone"), ("q", "tiny")}
    for s in ("big", "mid", "tiny"):
        assert report["p", s].taken == pytest.approx(report["p", s].wanted, abs=10)
    rows = m.sequence().filter("plan_id = 'p'").collect()
    assert max(r.repetition for r in rows) <= 3 and all(0 <= r.position <= 1 for r in rows)
    assert len({(r.doc_id, r.repetition) for r in rows}) == len(rows)
    early = [r.source for r in rows if r.position < 0.2]
    assert early.count("big") / len(early) > 0.5  # the natural share of big is above its target
    flat = [r.source for r in mix(spark, sizes, plan, strength=0.0).sequence().filter("plan_id = 'p' AND position < 0.2").collect()]
    assert flat.count("big") / len(flat) == pytest.approx(0.5 / 0.95, abs=0.03)
    assert {tuple(r) for r in m.sequence().collect()} == {tuple(r) for r in mix(spark, sizes[::-1], plan).sequence().collect()}


def test_mixing_edges(spark):
    empty = mix(spark, [], [("p", "a", 0.5, None)])
    assert empty.sequence().count() == 0 and not empty.report().first().short  # nothing is wanted of nothing
    assert mix(spark, [(1, "a", 5, None)], []).report().count() == 0
    none = mix(spark, [(1, "a", 5, None)], [("p", "a", 0.5, 0), ("p", "b", None, 3), ("p", None, 0.5, 3)])
    assert {r.source: r.short for r in none.report().collect()} == {"a": True, "b": False}


def test_tokens(spark):
    texts = ["Hello world", "", None, "größer " * 3, "x" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("tokens_", F.lit(1))
    got = {r.doc_id: r.tokens for r in with_tokens(rows, ["doc_id"]).collect()}
    from sightline.llm.tokens import DEFAULT_VOCABULARY

    e = encoding(DEFAULT_VOCABULARY)
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary(texts[3])) == texts[3]
