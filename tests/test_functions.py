import pytest
from pyspark.sql import functions as F

from sightline.functions import answers, geometry, parsers, text
from sightline.functions.hashing import stable_key, tie_breaker, uniform


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def said(spark, texts, what, vocabulary=()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    return [r[what] for r in parsers.parse(df, "t", [what], "v").orderBy("i").collect()]


def test_tokens(spark):
    spelled = ["Pcb1 ", "PCB1", " pcb1", "pipe fryum", "Pipe-Fryum", "pipe_fryum\t", "", "  ", None, "x"]
    assert values(spark, text.canonical_token("x"), spelled) == ["pcb1", "pcb1", "pcb1", "pipe_fryum", "pipe_fryum", "pipe_fryum", None, None, None, "x"]
    assert values(spark, text.canonical_split("x"), ["Training", "VAL", "testing ", "tset", None]) == ["train", "validation", "test", None, None]
    assert values(spark, text.canonical_id("x"), [" A-b ", "", None]) == ["a-b", None, None]


def test_normalisers(spark):
    assert values(spark, text.norm_name("x"), [" Small  Hole! ", "_a_", "Ünï"]) == ["small_hole", "a", "n"]
    assert values(spark, text.norm_label("x"), ["a & b", None]) == ["a_and_b", ""]
    assert values(spark, text.norm_text("x"), [" A\tb  C. ", "a c"]) == ["a b c.", "a c"]
    assert values(spark, text.norm_meta("x"), ["A_b,, c "]) == ["a b, c"]
    assert values(spark, text.split_compound("x"), ["b, a,b,,", None]) == [["a", "b"], []]
    assert values(spark, text.word_count("x"), [" a  b\nc ", "", None]) == [3, 0, 0]
    assert values(spark, text.strip("x"), ["\u00a0a b \t", "ab"]) == ["a b", "ab"]
    assert values(spark, text.contains_phrase("x", F.lit("small hole")), ["one small hole", "smaller hole"]) == [True, False]
    assert values(spark, text.humanize("x"), ["a_b,c", None]) == ["a b, c", "not applicable"]


def test_hash_keys(spark):
    import hashlib

    assert values(spark, stable_key(F.lit(42), "x", F.lit(None)), ["a"]) == [hashlib.sha256(b"42|a|").hexdigest()]
    assert values(spark, tie_breaker(F.lit(42), "x"), ["a"]) == [hashlib.sha256(b"42:a").hexdigest()]
    u = values(spark, uniform(F.lit(1), "x"), [str(i) for i in range(500)])
    assert all(0 <= x < 1 for x in u) and 0.4 < sum(u) / 500 < 0.6


@pytest.mark.parametrize(
    ("what", "cases"),
    [
        ("said_condition", [("There are no annotated anomalies.", "normal"), ("Yes, there is an anomaly.", "anomalous"), ('{"condition": "Pass"}', "normal"), ('{"pass": false}', "anomalous"), ('{"defect": null}', "normal"), ('{"defect_type": "none"}', "normal"), ("This looks normal to me", "normal"), ("It should not pass.", "anomalous"), ("a cat", None), ('```json\n{"status": "rejected"}\n```', "anomalous"), ('{"result": "the item is defective"}', "anomalous"), ('{"condition": "normal"} {"x": 1}', None), ("", None)]),
        ("said_product", [("printed circuit board 2", "pcb2"), ("A pipe fryum.", "pipe_fryum"), ('{"category": "Chewing gum"}', "chewinggum"), ("macaroni type 1", "macaroni1"), ("some pasta", None), ('[{"category": "candle"}]', "candle")]),
        ("said_location", [("upper-left corner", "top_left"), ("second row, third column", "center_right"), ("second row, second column", "center"), ('{"location": "middle"}', "center"), ('{"region": "lower right"}', "bottom_right"), ("first row and the 2nd column", "top_center"), ("nowhere", None)]),
        ("said_severity", [('{"severity": "mild"}', "minor"), ("major crack, minor dust", "major"), ('{"visual_severity": "odd"} moderate', "moderate"), ("fine", None)]),
        ("abstains", [("The cause cannot be determined.", True), ("It is caused by heat.", False)]),
    ],
)
def test_parsers(spark, what, cases):
    assert said(spark, [c[0] for c in cases], what) == [c[1] for c in cases]


def test_defects(spark):
    known = ["small_hole", "scratch", "chunk_of_gum_missing", "missing", "colour_spot"]
    texts = ["a small hole and a scratch", "chunk of gum missing", '{"defect_type": null, "defect": "scratch"}', '{"defect": "Scratch, small hole"}', '{"issue": ["a b", 3]}', '{"defect_type": 5} scratch', "nothing"]
    assert said(spark, texts, "said_defects", known) == [["scratch", "small_hole"], ["chunk_of_gum_missing", "missing"], [], ["scratch", "small_hole"], ["a_b"], ["scratch"], []]
    assert said(spark, ["small holes", "different colour spot"], "said_semantic", known) == [["hole", "small_hole"], ["color_spot", "different_color_spot"]] or said(spark, ["small holes"], "said_semantic", known) == [["small_hole"]]


def test_loose_json(spark):
    texts = ['{"a": 1}', 'text {"a": 1} more', '{"a": 1} x {"a": 2}', "[1]", "{bad}", None]
    assert [x is not None for x in said(spark, texts, "obj")] == [True, True, False, False, False, False]


def test_mask_of_a_corner(spark):
    cells = [("m", x, y, 2 if x >= 4 and y >= 4 else 0) for x in range(6) for y in range(6)]
    pixels = spark.createDataFrame(cells, "image_id string, x int, y int, v int")
    row = geometry.mask_features(pixels, spark.createDataFrame([("m", 6, 6)], "image_id string, width int, height int")).first()
    assert (row.area, row.x_min, row.x_max, row.box_width, row.x, row.x_max_normalized) == (4, 4, 5, 2, 4.5, 1.0)
    assert abs(row.ratio - 4 / 36) < 1e-12
    h = geometry.mask_histogram(pixels).first()
    assert (h.foreground_pixels, h.unique_values, h.is_binary, h.has_background) == (4, [0, 2], True, True)
    cell = spark.createDataFrame([(row.x_normalized, row.y_normalized)], "x double, y double").select(geometry.nine_grid("x", "y")).first()[0]
    assert cell == "bottom_right"


def test_severity(spark):
    rows = [(0.001, "dust"), (0.005, None), (0.02, ""), (0.0001, "corner_missing"), (0.001, "Cracks")]
    df = spark.createDataFrame(rows, "r double, d string")
    assert [x[0] for x in df.select(geometry.severity("r", "d")).collect()] == ["minor", "moderate", "major", "major", "major"]


def test_answers_and_their_json(spark):
    import json

    row = ("candle", "anomalous", 'wax "drip",melt', "top_left", 0.0123, "moderate")
    df = spark.createDataFrame([row, ("pcb1", "normal", None, None, 0.0, "none")], "category string, condition string, defect_type string, nine_grid_location string, anomaly_area_ratio double, visual_severity string")
    got = df.select(*(c.alias(k) for k, c in answers.answers().items())).collect()
    report = json.loads(got[0]["json"])
    assert report["defect_type"] == 'wax "drip", melt' and report["condition"] == "defective" and list(report) == sorted(report)
    assert json.loads(got[1]["json"])["location"] is None
    assert "1.230%" in got[0]["explanation"] and got[1]["binary"].startswith("The item is normal.")
