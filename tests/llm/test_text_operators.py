import os
import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import toxicity
from sightline.llm.toxicity import ToxicityModel, cleaned, rates, segments, words
from sightline.llm.truncation import TruncationModel, final_context, message_texts, trimmed, valley

TEXTS = "record_kind string, record_key bigint, origin string, col string, text string"
PRODUCTS = ["candle", "cashew", "pcb1", "fryum", "capsules"]
FORMS = ["The picture shows the family {p}.", "Sound item. The annotators left the picture of the {p} without any marking.", "Put the {p} aside and have it checked by hand before {n} pieces follow.", "{p}"]


def complete(rng):
    return rng.choice(FORMS).format(p=rng.choice(PRODUCTS), n=rng.randrange(1, 400))


def test_trimming():
    assert trimmed("It is whol…") == ("It is whol", True)
    assert trimmed("It is whol [cut]\n") == ("It is whol", True)
    assert trimmed("It is whole. (ref K-7527a)") == ("It is whole.", False)
    assert trimmed("It is whole.\n-- desk 4") == ("It is whole.", False)
    assert trimmed('{"a": 1}\n```') == ('{"a": 1}', False)
    assert final_context('{"a": "b", "c')[1] and not final_context('{"a": 1}')[1]
    assert final_context("x" * 10_000)[0] == "x" * 24 and len(final_context("")[0]) == 24


def test_counting_agrees_with_lookup():
    import numpy as np

    from sightline.llm import truncation as t

    texts = ["Alpha beta 123 gamma.", "", "Alpha  beta 9 gamma", '{"a": "x. y", "b', "ö" * 60]
    bits = np.full(t.LEAST_BITS // 8, 255, dtype=np.uint8)
    key, ends, seen = t._count("user", texts, [2, 1, 3, 1, 1], bits)
    table = dict(zip(key.tolist(), zip(ends.tolist(), seen.tolist())))
    tail, inside, _ = final_context("Alpha beta 7 gamma!")
    for h in t._contexts([tail], ["user"], [inside]).values():
        assert table[int(h[0])] == (5, 5)
    tail, inside, _ = final_context(texts[3])
    assert inside and all(int(h[0]) in table for h in t._contexts([tail], ["user"], [inside]).values())


def test_bit_table_holds_what_was_put_in():
    import numpy as np
    import pyarrow as pa

    from sightline.llm import truncation as t

    tails = [final_context(x)[0] for x in ("It is cut he", "a whole one.", "b", "", "ö" * 40)]
    batch = pa.RecordBatch.from_pydict({"col": ["user"] * 5, "tail": tails, "inside": [False] * 5})
    for size in (t.LEAST_BITS, 2 * t.LEAST_BITS):
        own, together = t._slices(size)
        parts = [r for b in own(iter([batch])) for r in b.to_pylist()]
        bits = np.zeros((size // t.SLICE, t.SLICE // 8), dtype=np.uint8)
        for part in parts:
            twice = pa.RecordBatch.from_pylist([part, part], schema=pa.schema([("slice", pa.int32()), ("bits", pa.binary())]))
            (one,) = (r for b in together(iter([twice])) for r in b.to_pylist())
            bits[one["slice"]] = np.frombuffer(__import__("zlib").decompress(one["bits"]), dtype=np.uint8)
        hashes = t._contexts(tails, ["user"] * 5, [False] * 5)
        assert all(t._known(h, bits.reshape(-1)).all() for h in hashes.values()) and np.unpackbits(bits).sum() <= 25
        assert not t._known(hashes[4] ^ np.uint64(1 << 63), bits.reshape(-1)).all()


REPORTS = [*FORMS, "The defect is a {d} near the {l} of the {p}, seen in {n} frames.", "Reject the {p} for manual review; annotated issue {d}, location {l}."]
DEFECTS, PLACES = ["small scratch", "crack", "hole", "color spot", "missing corner"], ["top left", "center", "bottom right", "top center"]


@pytest.mark.parametrize("copies", [1, 2, 3, 5, 10])
def test_repeated_cut_texts_are_found(spark, copies):
    rng = random.Random(4)
    make = lambda: rng.choice(REPORTS).format(p=rng.choice(PRODUCTS), n=rng.randrange(1, 400), d=rng.choice(DEFECTS), l=rng.choice(PLACES))
    rows, cut = [("instruction", i, "s", "assistant", make()) for i in range(4000)], set()
    while len(cut) < 100 * copies:
        whole = make()
        part = whole[: rng.randrange(12, max(13, len(whole) - 4))].rstrip()
        if whole.count(" ") < 4 or part[-1] in ".;,":
            continue
        text = part + rng.choice(["", "", " ", "…", " [cut]"])
        for _ in range(copies):
            rows.append(("instruction", 10_000 + len(cut), "s", "assistant", text))
            cut.add(10_000 + len(cut))
    found = {r.record_key for r in TruncationModel(spark.createDataFrame(rows, TEXTS)).cut_rows().collect()}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95


def test_marks_and_additions_have_no_limit():
    assert trimmed("It is whol" + "…" * 20 + " ..." * 9) == ("It is whol", True)
    assert trimmed("It is whol" + " [ cut ]" * 30) == ("It is whol", True)
    assert trimmed("It is whole.\n-- " + "desk " * 60 + "\n-- hall") == ("It is whole.", False)
    assert trimmed("It is whole. (ref " + "K" * 200 + ")") == ("It is whole.", False)
    assert trimmed("It is whol…\n-- desk 4 (see K-1)") == ("It is whol", True)
    assert trimmed("…") == ("", True) and trimmed("` (no)") == ("", False) and trimmed(")") == (")", False)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_redelivery_loses_nothing(spark):
    ins, pre = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("instructions", "predictions"))
    once = TruncationModel(message_texts(ins, pre)).cut_rows().cache()
    again = ins.join(once.filter("record_kind = 'instruction'").select(F.col("record_key").alias("delivery_id")), "delivery_id", "left_semi")
    said = pre.join(once.filter("record_kind = 'prediction'").select(F.col("record_key").alias("prediction_no")), "prediction_no", "left_semi")
    more = [10_000_000, 20_000_000, 30_000_000]
    for copies in (more[:1], more):
        for k in copies:
            ins2 = again.withColumn("delivery_id", F.col("delivery_id") + k)
            pre2 = said.withColumn("prediction_no", F.col("prediction_no") + k)
            all_ins, all_pre = (ins, pre) if k == copies[0] else (all_ins, all_pre)
            all_ins, all_pre = all_ins.unionByName(ins2), all_pre.unionByName(pre2)
        found = {tuple(r) for r in TruncationModel(message_texts(all_ins, all_pre)).cut_rows().collect()}
        want = {(r.record_kind, r.record_key + k) for r in once.collect() for k in (0, *copies)}
        assert want <= found and len(found) == len(want)


def test_valley():
    assert valley([(-8.0, 40), (5.0, 400)]) == pytest.approx(-1.5)
    assert valley([(-9.0, 2)]) == -1.5
    low = valley([(-8.0, 40), (-1.5, 300), (5.0, 400)])
    assert -4.5 <= low < -2.0


def test_cut_texts(spark):
    rng = random.Random(4)
    rows = [("instruction", i, "s", "assistant", complete(rng)) for i in range(3000)]
    cut = {}
    for i in range(3000, 3200):
        whole = FORMS[i % 3].format(p=rng.choice(PRODUCTS), n=9)
        words_ = whole.split()
        cut[i] = " ".join(words_[: rng.randrange(3, len(words_) - 2)])[: -rng.randrange(1, 3)] + rng.choice(["", " ", "…", " [cut]"])
    rows += [("instruction", i, "s", "assistant", t) for i, t in cut.items()]
    rows += [("instruction", 9000, "s", "assistant", None), ("instruction", 9001, "s", "assistant", " \n"), ("instruction", 9002, "s", "assistant", "A " * 60_000 + "candle."), ("instruction", None, "s", "assistant", "It sho"), *rows[:5]]
    rows += [("instruction", 9003, "s", "user", None), ("prediction", 1, "r", "prediction", '{"a": "b')]
    model = TruncationModel(spark.createDataFrame(rows, TEXTS))
    found = [r.record_key for r in model.cut_rows().filter("record_kind = 'instruction'").collect()]
    assert len(found) == len(set(found))
    hits = len(set(found) & set(cut))
    assert hits / len(cut) > 0.9 and len(set(found) - set(cut)) < 30 and not {9000, 9001} & set(found)
    again = {r.record_key for r in TruncationModel(spark.createDataFrame(rows, TEXTS).repartition(7)).cut_rows().filter("record_kind = 'instruction'").collect()}
    assert len(again ^ set(found)) <= 2
    rate = {r.origin: r for r in model.rates().collect()}
    assert rate["s"].cut == len(found)


def test_no_texts(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert TruncationModel(empty).cut_rows().count() == 0


def test_message_parts(spark):
    schema = "delivery_id bigint, messages array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>, metadata struct<source:string>"
    said = [("user", [("image", "i", None), ("text", None, "q")]), ("Assistant ", [("text", None, "a")]), ("system", [("text", None, "s")])]
    ins = spark.createDataFrame([(1, said, ("Visa ",)), (2, None, None)], schema)
    pre = spark.createDataFrame([(7, "run", "p")], "prediction_no bigint, run_id string, prediction string")
    got = {(r.record_kind, r.record_key, r.origin, r.col, r.text) for r in message_texts(ins, pre).filter("text IS NOT NULL").collect()}
    assert got == {("instruction", 1, "visa", "user", "q"), ("instruction", 1, "visa", "assistant", "a"), ("prediction", 7, "run", "prediction", "p")}


def test_disguise():
    assert words(cleaned("You i.d.i.o.t, sh1t and f**k!!!")) == ("you", "idiot", "shit", "and", "<masked>")
    assert words(cleaned("i d i o t")) == ("idiot",)
    assert words(cleaned("1d10t wh0r3 $lut @sshole a$$ 3asy b@$t@rd c0ck")) == ("idiot", "whore", "slut", "asshole", "ass", "easy", "bastard", "cock")
    assert words(cleaned("pcb1, macaroni2 and pcb4 at 12:30, 5mm, 1st, 80% of A-12")) == ("and", "at", "of")
    assert words(cleaned("tray F-1017g has pcb1 and 0.5 mm")) == ("tray", "has", "and", "mm")
    assert words(cleaned("<b>Gr&#252;&szlig;e</b> dÃ©faut sаlоре")) == ("grusse", "defaut", "salope")
    assert list(segments("One two. Three!\nfour")) == [("one", "two"), ("three",), ("four",)]
    assert max(map(len, segments("word " * 500))) <= toxicity.WINDOW


def corpus(rng, n=500):
    nice = ["the tray came back with {n} pieces", "please clean the lens before the next run", "women and men share one bench on the line", "this filthy gate stinks of oil", "both annotators agree on the mask"]
    rude = ["you are a worthless rat and a fool", "shut your mouth stupid fool", "people like you should never be hired you rat"]
    docs, labels = [], []
    for i in range(n):
        lines = [rng.choice(nice).format(n=rng.randrange(99)) for _ in range(rng.randrange(2, 7))]
        if bad := i % 8 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(rude))
        docs.append((i, ". ".join(lines) + ".", " Notes ", None))
        if i % 2 == 0:
            labels.append((i, ["abusive", "SEXUAL"][i % 3 == 0] if bad else "clean", "x"))
    return docs, labels


DOCS, LABELS = "doc_id bigint, text string, source string, score string", "doc_id bigint, label string, rater string"


def test_toxicity(spark):
    docs, labels = corpus(random.Random(6))
    docs += [(9000, None, None, None), (9001, " ", "x", None), (9002, "clean words " * 20_000, "x", None), docs[0], docs[1]]
    labels += [(2, None, "y"), (4, "abusive", "y"), (77777, "clean", "z"), (None, "clean", "z")]
    df = spark.createDataFrame(docs, DOCS)
    model = ToxicityModel(df, spark.createDataFrame(labels, LABELS))
    got = model.scores(df).collect()
    assert len(got) == len(docs) and model.quality["f1"] > 0.9
    flagged = {r.doc_id for r in got if r.toxic}
    truth = {i for i in range(500) if i % 8 == 0}
    assert len(flagged ^ truth) <= 3 and not flagged & {9000, 9001, 9002}
    assert {r.source: r.toxic for r in rates(model.scores(df)).collect()}["notes"] >= len(truth)


def test_models_equal_the_formula():
    import math
    from collections import Counter

    import numpy as np

    from sightline.llm import toxicity as t

    toxic = {("you", "fool"): 3, ("you", "rat"): 1, ("a", "fool"): 1}
    ordinary = {("a", "tray"): 4, ("you", "see", "a", "tray"): 2, ("clean",): 1}
    all_ = [*toxic, *ordinary]
    table = t.Table(all_)
    models = table.trained(np.array([toxic.get(s, 0) for s in all_]), np.array([ordinary.get(s, 0) for s in all_]))
    pairs = {(a, b) for s in all_ for a, b in zip(("<s>", *s), (*s, "</s>"))}
    total = len(pairs) + 1.0
    before = Counter(b for _, b in pairs)
    rest = (t.DISCOUNT * len(before) + 1) / total / (len(before) + 1 + 10_000)

    def logs(counted, segment):
        tri = Counter()
        for s, n in counted.items():
            p = ("<s>", "<s>", *s, "</s>")
            for i in range(len(p) - 2):
                tri[p[i : i + 3]] += n
        bi = Counter(x[1:] for x in tri)
        uni = Counter(x[1] for x in bi)
        out, p = 0.0, ("<s>", "<s>", *segment, "</s>")
        for u, v, x in zip(p, p[1:], p[2:]):
            low = (before[x] - t.DISCOUNT) / total if x in before else rest
            q = (1 - t.SHARED) * uni[x] / sum(uni.values()) + t.SHARED * low
            for counts, context in ((bi, (v,)), (tri, (u, v))):
                own = {k: n for k, n in counts.items() if k[:-1] == context}
                if own:
                    q = (max(own.get((*context, x), 0) - t.DISCOUNT, 0) + t.DISCOUNT * len(own) * q) / sum(own.values())
            out += math.log(q)
        return out

    asked = [*all_, ("you", "unknown"), ("fool",), ("tray", "fool", "fool")]
    want = [(logs(toxic, s) - logs(ordinary, s)) / (len(s) + 1) for s in asked]
    assert models.score(asked) == pytest.approx(want) and table.scores(models) == pytest.approx(want[: len(all_)])


def test_toxicity_without_classes(spark):
    df = spark.createDataFrame(corpus(random.Random(1), 20)[0], DOCS)
    none = ToxicityModel(df, spark.createDataFrame([], LABELS))
    assert none.scores(df).filter("toxic").count() == 0
    one = ToxicityModel(df, spark.createDataFrame([(1, "clean", "a"), (2, "clean", "a")], LABELS))
    assert one.scores(df).filter("toxic").count() == 0 and one.scores(df.filter("false")).count() == 0
