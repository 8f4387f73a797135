import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from sightline.sources import acquire, readers, sinks
from sightline.streaming import resume

S = "id string, n bigint"


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_jsonl_readers(spark, tmp_path):
    good = put(tmp_path, "good.jsonl", '{"id": "a", "n": 1}\n\n{"id": "b", "n": null}\n')
    bad = put(tmp_path, "bad.jsonl", '{"id": "a", "n": 1}\n[1]\n{"id": "b", "n"\n')
    assert readers.jsonl_strict(spark, good, S).count() == 2
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, bad, S).collect()
    rows, errors = readers.jsonl_permissive(spark, bad, S)
    assert [r.id for r in rows.collect()] == ["a"] and errors.count() == 2
    rows, errors = readers.jsonl_permissive(spark, str(tmp_path / "none"), S)
    assert rows.count() == 0 and errors.count() == 1


def test_torn_tail(spark, tmp_path):
    torn = put(tmp_path, "torn.jsonl", '{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n{"id": "c", ')
    assert sorted(r.id for r in readers.jsonl_torn_tail(spark, torn, S).collect()) == ["a", "b"]
    inner = put(tmp_path, "inner.jsonl", '{"id": "a", "n": 1}\n{"id": \n{"id": "c", "n": 3}\n')
    with pytest.raises(Exception):
        readers.jsonl_torn_tail(spark, inner, S).collect()


def test_ordinals(spark, tmp_path):
    put(tmp_path, "d/a.txt", "one\n\ntwo\n")
    put(tmp_path, "d/b.txt", "three")
    indexed = readers.with_ordinal(readers.numbered_lines(spark, str(tmp_path / "d")))
    assert [r.value for r in indexed.orderBy("ordinal").collect()] == ["one", "two", "three"]
    assert readers.record_at(indexed, -1).first().value == "three"
    with pytest.raises(IndexError):
        readers.record_at(indexed, 3)


def test_keys_and_splits(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, dataset_split string")
    assert readers.unique_keys(df, "id", ["dataset_split"]).count() == 2
    with pytest.raises(ValueError):
        readers.unique_keys(df.union(df), "id", [])
    with pytest.raises(ValueError):
        readers.unique_keys(df.withColumn("id", F.lit(None).cast("string")), "id", [])
    with pytest.raises(ValueError):
        readers.only_split(df, "x")
    assert readers.without_split(df).columns == ["id"]


def test_annotations(spark, tmp_path):
    put(tmp_path, "c/a.csv", "\ufeffobject,split,label,image,mask\npcb1,train,normal,1.jpg,\n\"pcb1\",test,\"bent,melt\",2.jpg,2.png\n")
    put(tmp_path, "c/b.csv", "image,label,mask\n3.jpg,normal,\n")
    put(tmp_path, "c/z.csv", "foo,bar\n1,2\n")
    rows, bad = readers.annotations(spark, str(tmp_path / "c"))
    got = {r.image: r for r in rows.collect()}
    assert got["2.jpg"].label == "bent,melt" and got["2.jpg"].row_number == 3 and got["3.jpg"].object is None
    assert len(bad) == 1 and bad[0][0].endswith("z.csv")
    assert {r.data_rows for r in readers.csv_inventory(spark, str(tmp_path / "c")).collect()} == {2, 1}


def test_records_over_several_lines(spark, tmp_path):
    rows = [("object,split,label,image,mask\n")] + [f'pcb1,train,"a {i}\nb ""q"" {i}",{i}.jpg,m\n' if i % 7 == 0 else f"pcb1,train,normal,{i}.jpg,\n" for i in range(400)]
    put(tmp_path, "m/a.csv", "".join(rows) + "\n\n")
    put(tmp_path, "m/b.csv", "image,label,mask\n\n3.png,normal,\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many blocks a file
    try:
        got = {r.image: r for r in readers.annotations(spark, str(tmp_path / "m"))[0].collect()}
        lines = readers.numbered_lines(spark, str(tmp_path / "m")).filter("file LIKE '%b.csv'").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 401 and got["7.jpg"].label == 'a 7\nb "q" 7' and got["7.jpg"].row_number == 9 and got["399.jpg"].row_number == 401
    assert {r.row_number: r.value for r in lines} == {1: "image,label,mask", 3: "3.png,normal,"}


def test_acquire(tmp_path):
    import json
    import tarfile

    put(tmp_path, "src/top/a.JPG", "x")
    put(tmp_path, "src/top/b.csv", "y")
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.add(tmp_path / "src/top", "top")
    run = lambda expected: acquire.acquire(f"file://{tmp_path}/a.tar", str(tmp_path / "got.tar"), str(tmp_path / "out"), expected, str(tmp_path / "receipt.json"))
    assert run({".jpg": 1, ".csv": 1})["root"].endswith("top")
    with pytest.raises(ValueError):
        run({".jpg": 2})
    assert json.loads((tmp_path / "receipt.json").read_text())["differences"] == {".jpg": {"expected": 2, "found": 1}}


def test_images_and_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 8, 6) + b"\x08\x00\x00\x00\x00"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 6, 9) + b"\x01\x00\x00\x00"
    for name, blob in (("i/a.PNG", png), ("i/b.jpg", jpeg), ("i/c.jpg", b"no"), ("i/masks/a.png", png)):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(blob)
    got = {r.path.split("/")[-1]: (r.width, r.height, r.format, r.error) for r in readers.image_sizes(spark, str(tmp_path / "i")).filter("path NOT LIKE '%masks%'").collect()}
    assert got["a.PNG"] == (8, 6, "PNG", None) and got["b.jpg"] == (9, 6, "JPEG", None) and got["c.jpg"][3] is not None
    assert readers.files(spark, str(tmp_path / "i"), [".png", ".jpg"]).count() == 3
    assert readers.digests(spark, str(tmp_path / "i")).select("sha256").distinct().count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "train", None), ("a", "test", 1), ("c", "train", 2)], "id string, split string, n int")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert any('"n":null' in line for line in (r.value for r in spark.read.text(str(tmp_path / "j")).collect()))
    sinks.partitioned_jsonl(df, str(tmp_path / "p"), "split", "id")
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["split=test", "split=train"]
    sinks.csv_assignments(df, str(tmp_path / "c"), ["id", "split", "n"], "id")
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[0] == "id,split,n" and "b,train," in lines
    assert sinks.union_columns([df, df.select(F.lit(1).alias("a"))]).columns == ["a", "id", "n", "split"]
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 6
    sinks.atomic_json({"a": [1]}, str(tmp_path / "r" / "x.json"))
    assert sinks.mirror(str(tmp_path / "r" / "x.json"), str(tmp_path / "m" / "x.json")) and not sinks.mirror("/nowhere", "x")
    assert sinks.gallery(df, ["id", "split"], str(tmp_path / "g.html"))["split"] == 2
    sinks.dataset_card("t", {"rows": 3}, str(tmp_path / "card.md"))
    assert sinks.tar_bundle([str(tmp_path / "r")], str(tmp_path / "b.tgz")) == {str(tmp_path / "r"): 1}
    assert [m["path"] for m in sinks.snapshot_zip(str(tmp_path / "r"), str(tmp_path / "s.zip"), ["m"], 10**6)] == ["x.json"]


def test_safe_extract_and_config(tmp_path):
    put(tmp_path, "src/top/a.txt", "x")
    with tarfile.open(tmp_path / "ok.tar", "w") as t:
        t.add(tmp_path / "src" / "top", arcname="top")
    assert acquire.extract(str(tmp_path / "ok.tar"), str(tmp_path / "out")).endswith("top")
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        t.add(tmp_path / "src" / "top" / "a.txt", arcname="../evil.txt")
    with pytest.raises(ValueError):
        acquire.extract(str(tmp_path / "bad.tar"), str(tmp_path / "out"))
    assert acquire.load_config(put(tmp_path, "c.json", '{"seed": 1}'), {"seed": int}) == {"seed": 1}
    with pytest.raises(ValueError):
        acquire.load_config(put(tmp_path, "d.json", '{"seed": "x", "y": 1}'), {"seed": int})
    assert acquire.head("http://127.0.0.1:9/x", 0.2)["length"] is None


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, t string")
    source, log, state = (str(tmp_path / x) for x in ("w", "log", "state"))
    run = lambda **k: resume.run_once(spark, source, work.schema, log, state, "id", lambda d: d.select("id", F.upper("t").alias("r"), F.when(F.col("id") == 3, "bad").alias("error")), **k)
    work.filter("id < 4").write.parquet(source)
    run()
    work.filter("id >= 2").write.mode("append").parquet(source)
    run()
    done = spark.read.parquet(log)
    assert done.count() == 10 and resume.duplicates(done, "id").isEmpty()
    assert resume.progress(spark, log, work, "id") == {"work": 10, "done": 10, "pending": 0}
    work.withColumn("id", F.col("id") + 100).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        run(max_errors=0)
