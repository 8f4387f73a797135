import datetime as dt

import numpy as np
import pytest

from sightline.llm.permanent import PermanentStore, stable_samples
from sightline.llm.proportions import ProportionalSample, rake, repair
from sightline.storage import scratch_path

INSTRUCTION = "delivery_id bigint, instruction_id string, dataset_split string, task_family string, metadata struct<condition:string,category:string>, delivered_at timestamp, metadata_extra string"
RUNS, TARGETS = "run_id string, train_limit bigint, subset_seed bigint", "target_id bigint, run_id string, task_family string, condition string, category string, target_share double, min_count bigint"
T0 = dt.datetime(2025, 1, 1)


def deliveries(spark, n=600):
    rows = []
    for i in range(n):
        category = "big" if i % 10 else "small"
        rows.append((i, f"Rec{i} ", "Train" if i % 6 else "test", ["a", "b-c"][i % 2], ("normal" if i % 3 else "anomalous", f" {category.upper()}"), T0 + dt.timedelta(days=i % 50), None))
    rows += [(n, "rec1", "train", "a", (None, "big"), T0, None), (n + 1, None, "train", "a", ("normal", "big"), T0, None), (n + 2, "rec2", None, None, None, None, None)]
    return spark.createDataFrame(rows, INSTRUCTION)


def test_rake_meets_margins_and_supply():
    supply = np.array([100, 100, 5, 50])
    margins = [[(np.array([0, 1]), 60.0), (np.array([2, 3]), 40.0)], [(np.array([0, 2]), 30.0), (np.array([1, 3]), 70.0)]]
    x = rake(supply, margins, 100)
    assert abs(x.sum() - 100) < 1e-3 and (x <= supply + 1e-9).all()
    assert abs(x[[0, 1]].sum() - 60) < 0.5 and abs(x[[0, 2]].sum() - 30) < 0.5
    assert rake(supply, margins, 10_000).sum() == pytest.approx(supply.sum())
    assert rake(np.array([], dtype=int), [], 10).sum() == 0


def test_repair_keeps_minimums():
    supply, taken = np.array([100, 10, 3]), np.array([60, 0, 0])
    out = repair(taken, supply, [(np.array([0]), 50.0, 0), (np.array([1]), 5.0, 7), (np.array([2]), 5.0, 9)], 60)
    assert out.sum() == 60 and out[1] >= 7 and out[2] == 3


def sampled(spark, rows, targets, limit=120, parts=3):
    runs = spark.createDataFrame([("r", limit, 42)], RUNS)
    s = ProportionalSample(rows.repartition(parts), runs, spark.createDataFrame(targets, TARGETS))
    return {r.instruction_id for r in s.sample.collect()}, {r.target_id: r for r in s.report().collect()}


def test_proportions(spark):
    targets = [(1, "r", "A", None, None, 0.25, 0), (2, "r", "b c", None, None, 0.75, 0), (3, "r", None, None, "small", 0.0, 20), (4, "r", None, None, "absent", 0.1, 5)]
    rows = deliveries(spark)
    ids, report = sampled(spark, rows, targets)
    again, _ = sampled(spark, rows, targets, parts=7)
    assert ids == again and len(ids) == 120
    assert report[1].share == pytest.approx(0.25, abs=0.02) and report[3].sampled >= 20
    assert report[4].supply == 0 and report[4].unmeetable and report[4].gap == 12.0
    assert not report[1].unmeetable and report[1].supply == sum(1 for i in range(600) if i % 6 and i % 2 == 0) + 1  # rec1 was delivered under both families


def test_proportions_beyond_broadcast(spark, monkeypatch):
    from sightline.llm import proportions

    targets = [(1, "r", "A", None, None, 0.25, 0), (2, "r", "b c", None, None, 0.75, 0)]
    want, _ = sampled(spark, deliveries(spark), targets)
    monkeypatch.setattr(proportions, "MAX_BROADCAST", 0)
    assert sampled(spark, deliveries(spark), targets)[0] == want


def test_bounds_change_nothing(spark, monkeypatch):
    from sightline.llm import proportions

    targets = [(1, "r", "A", None, None, 0.25, 0), (2, "r", "b c", None, None, 0.75, 0), (3, "r", None, None, "small", 0.0, 20)]
    rows = deliveries(spark, 3000)
    want, _ = sampled(spark, rows, targets)
    monkeypatch.setattr(proportions, "key_bound", lambda *_: float("inf"))
    monkeypatch.setattr(proportions, "sure_share", lambda *_: 1.0)
    assert sampled(spark, rows, targets)[0] == want
    monkeypatch.setattr(proportions, "key_bound", lambda *_: 1e-9)  # too low, so all is looked at again
    monkeypatch.setattr(proportions, "sure_share", lambda *_: 1e-9)
    assert sampled(spark, rows, targets)[0] == want


def test_sample_meets_every_minimum_that_supply_allows(spark):
    targets = [(1, "r", "a", None, None, 0.5, 0), (2, "r", "b c", None, None, 0.5, 0), (3, "r", None, "anomalous", "small", 0.0, 15), (4, "r", "a", "normal", "small", 0.0, 12), (5, "r", None, None, "absent", 0.0, 5)]
    ids, report = sampled(spark, deliveries(spark, 1200), targets, limit=100)
    assert len(ids) == 100
    for t in report.values():
        assert t.sampled >= min(t.min_count, t.supply)


def test_proportions_edges(spark):
    targets = [(1, "r", None, None, None, None, None), (2, "nobody", "a", None, None, 0.5, 1), (1, "r", None, None, None, None, None)]
    ids, report = sampled(spark, deliveries(spark), targets, limit=None)
    assert len(ids) == 500 and list(report) == [1]
    ids, report = sampled(spark, deliveries(spark).filter("false"), [(1, "r", "a", None, None, 1.0, 3)])
    assert not ids and report[1].unmeetable


def snapshots(spark):
    return spark.createDataFrame([(2, T0 + dt.timedelta(days=20)), (1, T0 + dt.timedelta(days=5)), (3, T0 + dt.timedelta(days=90)), (9, None)], "snapshot_no int, until_at timestamp")


def picks(spark, rows, runs):
    out: dict = {}
    for r in stable_samples(rows, spark.createDataFrame(runs, RUNS), snapshots(spark)).collect():
        out.setdefault((r.run_id, r.snapshot_no), set()).add(r.instruction_id)
    return out


def test_permanent_numbers(spark):
    runs = [("small", 30, 42), ("large", 150, 42), ("other", 30, 7), ("all", None, 42), ("none", 0, 1), ("over", 10**7, None)]
    rows = deliveries(spark)
    got = picks(spark, rows, runs)
    assert got == picks(spark, rows.repartition(9), runs)
    assert len(got["small", 1]) == 30 and got["small", 1] == got["small", 3]
    assert len(got["large", 1]) < 150 and got["large", 1] < got["large", 2] and len(got["large", 3]) == 150
    assert got["small", 2] <= got["large", 2] and got["other", 1] != got["small", 1]
    assert len(got["all", 3]) == 500 and got["over", 3] == got["all", 3] and ("none", 3) not in got
    assert picks(spark, rows.filter("false"), runs) == {}


def test_late_records_displace_nothing(spark):
    path, rows = scratch_path(spark, "kept"), deliveries(spark)
    runs = spark.createDataFrame([("small", 30, 42), ("large", 150, 42), ("all", None, 42)], RUNS)

    def at(data):
        out: dict = {}
        for r in stable_samples(data, runs, snapshots(spark), path).collect():
            out.setdefault((r.run_id, r.snapshot_no), set()).add(r.instruction_id)
        return out

    first = at(rows.filter("delivery_id % 3 > 0 AND delivery_id < 600"))
    second = at(rows)
    assert all(first[k] <= second[k] for k in first) and len(second["all", 3]) == 500
    assert first["small", 3] == second["small", 3] and at(rows) == second


def test_thresholds_never_fall(spark):
    path, rows = scratch_path(spark, "thresholds"), deliveries(spark)
    runs = spark.createDataFrame([("small", 30, 42), ("large", 150, 42), ("all", None, 42)], RUNS)
    stable_samples(rows.filter("delivery_id % 3 > 0"), runs, snapshots(spark), path).count()
    noted = [PermanentStore(spark, path).thresholds().collect()]
    stable_samples(rows, runs, snapshots(spark), path).count()
    noted.append(PermanentStore(spark, path).thresholds().collect())
    of = lambda table, run: sorted((r.snapshot_no, r.cohort, r.value) for r in table if r.run_id == run)
    for run in ("small", "large", "all"):
        first = of(noted[0], run)
        assert len(first) == 3 and all(a[1:] <= b[1:] for a, b in zip(first, first[1:]))
        both = of(noted[1], run)
        assert len(both) == 6 and all(max(b[1:] for b in both if b[0] == s) >= (c, v) for s, c, v in first)


def test_store_never_changes(spark):
    store = PermanentStore(spark, scratch_path(spark, "test"))
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "instruction_id string")
    store.insert(ids, 0)
    first = {tuple(r) for r in store.read().collect()}
    store.insert(ids, 1)
    assert {tuple(r) for r in store.read().collect()} == first and len(first) == 2
    store.insert(spark.createDataFrame([("c",)], "instruction_id string"), 1)
    assert {r.cohort for r in store.read().filter("instruction_id = 'c'").collect()} == {1}
