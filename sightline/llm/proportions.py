"""Samples that match target category proportions.

Three steps, each over all records:

1. *Rake.* Iterative proportional fitting over the margins given by the targets yields one expected count per stratum
   (task family x condition x category) and run. Strata hold only values that targets name, all others count as one more
   value, so their number is bounded by the targets table and the fitting runs on the driver.
2. *Sample.* Every record gets the exponential key ``-ln(1 - u) / w`` with the weight of its stratum and a uniform ``u``
   from its identifier; the ``train_limit`` smallest keys of a run are its sample. This is an exact weighted sample
   without replacement that no partitioning can change.
3. *Repair.* Where a target stays below its minimum, its strata take more (the next smallest keys), and strata of targets
   above their goals give back as many. What can't be met is reported.

A record belongs to the stratum of its fullest train delivery (then the latest). Supply and achieved counts look at
all train deliveries of a record. Defined results: rows without an identifier or without split train are ignored; null
labels match only "any"; a null limit takes all records; null shares and minimums count as 0; an empty pool gives an empty
sample and a report of gaps; repeated targets (same target_id) count once.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform
from sightline.functions.text import canonical_id, canonical_split, canonical_token
from sightline.operators.ranking import bottom_k
from sightline.storage import BoundExceeded, bounded_rows, cut_lineage

ATTRIBUTES = ["task_family", "condition", "category"]
#: Any value that no target names.
OTHER = ""
#: The mark of "any" in keys.
ANY = "*"
MAX_TARGETS = 20_000
#: Strata times targets that are fitted on the driver.
MAX_FITTED = 20_000_000
#: Rows of a strata table that may be broadcast, a few MB; parts of a stratum where it is shuffled instead.
MAX_BROADCAST = 50_000
SALTS = 32


def train_records(instructions: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """One row per record with a train delivery: its identifier, all its cells, and its stratum's three values."""

    def value(c: Column, name: str) -> Column:
        token = canonical_token(c)
        return F.when(token.isin(named[name]), token).otherwise(F.lit(OTHER)) if named[name] else F.lit(OTHER)

    rows = instructions.select(
        canonical_id("instruction_id").alias("instruction_id"),
        canonical_split("dataset_split").alias("split"),
        value(F.col("task_family"), "task_family").alias("task_family"),
        value(F.col("metadata.condition"), "condition").alias("condition"),
        value(F.col("metadata.category"), "category").alias("category"),
        "delivered_at",
        "delivery_id",
    ).filter("split = 'train' AND instruction_id IS NOT NULL")
    filled = sum((F.col(a) != OTHER).cast("int") for a in ATTRIBUTES)
    best = F.max(F.struct(filled.alias("filled"), "delivered_at", "delivery_id", *ATTRIBUTES)).alias("best")
    return rows.groupBy("instruction_id").agg(F.array_sort(F.collect_set(F.struct(*ATTRIBUTES))).alias("cells"), best).select("instruction_id", "cells", *(f"best.{a}" for a in ATTRIBUTES))


def count_by_target(records: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Distinct records that match each target, looking at all cells of a record; ``by``: further keys of both tables.

    Records with equal cells are counted first, so only a few rows are spread over the eight patterns of "any".
    """
    alike = records.groupBy(*by, "cells").agg(F.count("*").alias("n"))
    patterns = [F.struct(*(F.lit(ANY).alias(a) if mask >> i & 1 else F.col(f"cell.{a}").alias(a) for i, a in enumerate(ATTRIBUTES))) for mask in range(8)]
    counts = (
        alike.withColumn("cell", F.explode("cells"))
        .select(*by, "cells", "n", F.explode(F.array(*patterns)).alias("p"))
        .distinct()
        .groupBy(*by, *(F.col(f"p.{a}").alias(a) for a in ATTRIBUTES))
        .agg(F.sum("n").alias("matched"))
    )
    return targets.join(counts, [*by, *ATTRIBUTES], "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("bigint"))


def rake(supply: np.ndarray, margins: list[list[tuple[np.ndarray, float]]], limit: float, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Expected counts per stratum: as near to the margins as the supply allows, ``limit`` in all.

    ``margins``: per margin the goals of disjoint sets of strata. Each round scales the sets of every margin to their
    goals and holds strata at their supply. What capped strata can't give goes to the others in proportion, first to those
    that targets want, then to the rest.
    """
    limit = min(limit, float(supply.sum()))
    x = supply.astype(float).copy()
    if limit <= 0 or not len(x):
        return np.zeros_like(x)
    x *= limit / x.sum()
    for _ in range(rounds):
        before = x.copy()
        for margin in margins:
            for members, goal in margin:
                goal = min(goal, supply[members].sum())
                for _ in range(4):  # strata at their supply leave the rest of the goal to the others
                    total, free = x[members].sum(), x[members] < supply[members]
                    if total <= 0 or abs(total - goal) < tolerance:
                        break
                    part = x[members]
                    if goal > total and free.any():
                        part[free] *= (goal - part[~free].sum()) / max(part[free].sum(), 1e-300)
                    else:
                        part *= goal / total
                    x[members] = np.minimum(part, supply[members])
        if np.abs(x - before).max() < tolerance:
            break
    for _ in range(60):
        lack = limit - x.sum()
        if lack < -tolerance:
            x *= limit / x.sum()
        if lack <= tolerance:
            break
        room = supply - x
        wanted = np.where((x > tolerance) & (room > tolerance), np.maximum(x, tolerance), 0.0)
        wanted = wanted if wanted.sum() > 0 else room
        x = np.minimum(x + wanted * lack / wanted.sum(), supply)
    return x


def repair(taken: np.ndarray, supply: np.ndarray, targets: list[tuple[np.ndarray, float, int]], limit: int) -> np.ndarray:
    """Integer counts per stratum, ``limit`` in all as far as minimums and supply allow.

    ``targets``: members, goal and minimum. Every target is raised to its goal and minimum, as far as its supply reaches.
    What that adds is given back by strata above their goals, then by all in proportion, but never below a minimum.
    """
    out = np.minimum(taken.copy(), supply)
    least = [min(int(low), int(supply[members].sum())) for members, _, low in targets]
    of = [[i for i, (members, _, _) in enumerate(targets) if j in members] for j in range(len(out))]
    for (members, goal, low), hard in zip(targets, least):
        lack = min(max(hard, round(goal)), int(supply[members].sum())) - int(out[members].sum())
        for j in members[np.argsort(-(supply[members] - out[members]), kind="stable")]:
            if lack <= 0:
                break
            step = min(lack, int(supply[j] - out[j]))
            out[j] += step
            lack -= step
    sums = [int(out[members].sum()) for members, _, _ in targets]
    excess = int(out.sum()) - limit

    def spare(j: int) -> int:
        """How many the stratum can give without breaking a minimum."""
        return max(0, min([int(out[j]), *(sums[i] - least[i] for i in of[j])]))

    def above(j: int) -> float:
        """How far every target of the stratum lies above its goal."""
        return min((sums[i] - targets[i][1] for i in of[j]), default=math.inf)

    def give(j: int, step: int) -> int:
        out[j] -= step
        for i in of[j]:
            sums[i] -= step
        return step

    for j in sorted(range(len(out)), key=lambda j: (-above(j), -out[j], j)):
        if excess > 0 and above(j) > 0:
            excess -= give(j, int(min(spare(j), excess, math.ceil(min(above(j), excess)))))
    while excess > 0 and any(spare(j) for j in range(len(out))):
        total = int(out.sum())
        for j in sorted(range(len(out)), key=lambda j: (-out[j], j)):
            excess -= give(j, min(spare(j), excess, max(1, excess * int(out[j]) // max(total, 1))))
    return out


def sure_share(n: int, supply: int) -> float:
    """The share of uniform numbers below which ``n`` of ``supply`` lie nearly surely."""
    return min(1.0, (n + 8 * math.sqrt(n) + 60) / max(supply, 1))


def key_bound(strata: list[tuple[int, float]], limit: int) -> float:
    """An exponential key below which nearly surely ``limit`` records lie. ``strata``: supply and weight."""
    supply, weight = np.array([n for n, _ in strata], dtype=float), np.array([w for _, w in strata])
    wanted = limit + 8 * math.sqrt(limit) + 60
    if wanted >= supply.sum():
        return math.inf
    low, high = 0.0, 1.0
    while (supply * -np.expm1(-weight * high)).sum() < wanted and high < 1e15:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (supply * -np.expm1(-weight * middle)).sum() < wanted else (low, middle)
    return high


def _members(strata: list[tuple], target: dict) -> np.ndarray:
    return np.array([j for j, s in enumerate(strata) if all(target[a] in (ANY, s[i]) for i, a in enumerate(ATTRIBUTES))], dtype=int)


class ProportionalSample:
    """Samples and report of all runs that have targets.

    ``instructions``: deliveries of records; ``runs``: run_id, train_limit, subset_seed; ``targets``: target_id, run_id,
    the three attributes (null: any), target_share, min_count. Both small tables are bounded by MAX_TARGETS rows.
    """

    def __init__(self, instructions: DataFrame, runs: DataFrame, targets: DataFrame) -> None:
        self.spark = instructions.sparkSession
        by_run = {r["run_id"]: r for r in bounded_rows(runs.select("run_id", "train_limit", "subset_seed").filter("run_id IS NOT NULL").orderBy("run_id", F.col("train_limit").desc()), MAX_TARGETS, "runs")}
        rows = targets.filter("target_id IS NOT NULL").select("target_id", "run_id", *(F.coalesce(canonical_token(a), F.lit(ANY)).alias(a) for a in ATTRIBUTES), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_count", F.lit(0)).cast("bigint").alias("min_count"))
        self.targets = {r["target_id"]: r.asDict() for r in bounded_rows(rows.orderBy("target_id"), MAX_TARGETS, "targets") if r["run_id"] in by_run}
        named = {a: sorted({t[a] for t in self.targets.values()} - {ANY}) for a in ATTRIBUTES}
        self.records = cut_lineage(train_records(instructions, named), "p1-records")
        # as many strata as combinations of named values and one more each
        combinations = math.prod(len(v) + 1 for v in named.values())
        if combinations * max(len(self.targets), 1) > MAX_FITTED:
            raise BoundExceeded(f"{len(self.targets)} targets over {combinations} strata are more than the driver fits")
        strata = bounded_rows(self.records.groupBy(*ATTRIBUTES).agg(F.count("*").alias("n")).orderBy(*ATTRIBUTES), combinations, "strata")
        self.strata = [tuple(r[a] for a in ATTRIBUTES) for r in strata]
        self.supply = np.array([r["n"] for r in strata], dtype=np.int64)
        total = int(self.supply.sum())
        self.runs: dict[str, dict] = {}
        for t in self.targets.values():
            run = by_run[t["run_id"]]
            limit = total if run["train_limit"] is None else min(max(int(run["train_limit"]), 0), total)
            self.runs.setdefault(t["run_id"], {"limit": limit, "asked": run["train_limit"], "seed": run["subset_seed"] or 0, "targets": []})["targets"].append((_members(self.strata, t), t))
        self.sample = self._repaired(self._drawn())

    def _rates(self) -> list[tuple]:
        """Per run and stratum that may be drawn from: (run, stratum number, its values, weight, limit, seed)."""
        rates = []
        for name, run in self.runs.items():
            margins: dict[tuple, list] = defaultdict(list)
            for members, t in run["targets"]:
                margins[tuple(t[a] == ANY for a in ATTRIBUTES)].append((members, t["target_share"] * run["limit"]))
            full = []
            for margin in margins.values():
                seen = np.unique(np.concatenate([m for m, _ in margin])) if margin else np.array([], dtype=int)
                others = np.setdiff1d(np.arange(len(self.strata)), seen)
                full.append([*((m, g) for m, g in margin if len(m)), *([(others, max(0.0, run["limit"] - sum(g for _, g in margin)))] if len(others) else [])])
            x = rake(self.supply, full, run["limit"])
            for j, stratum in enumerate(self.strata):
                share = min(x[j] / self.supply[j], 1.0) if self.supply[j] else 0.0
                if share > 0:
                    rates.append((name, j, *stratum, float(-math.log1p(-min(share, 1 - 1e-12))), int(run["limit"]), int(run["seed"])))
        return rates

    def _drawn(self) -> dict[str, np.ndarray]:
        """The weighted draw: how many of each stratum are among a run's smallest keys.

        Only keys below a bound that nearly surely holds enough of them go on; where a run comes out short, all do.
        """
        rates = self._rates()
        by_run: dict[str, list[tuple]] = defaultdict(list)
        for r in rates:
            by_run[r[0]].append(r)
        bounds = {name: key_bound([(self.supply[r[1]], r[5]) for r in own], self.runs[name]["limit"]) for name, own in by_run.items()}
        for bounded in (True, False):
            rows = [(*r, bounds[r[0]] if bounded else math.inf) for r in rates]
            schema = "run_id string, stratum int, task_family string, condition string, category string, weight double, k bigint, seed bigint, most double"
            rated = self._with_small(self.records.select("instruction_id", *ATTRIBUTES), rows, schema, ATTRIBUTES).withColumn("u", uniform("seed", "instruction_id"))
            rated = rated.withColumn("at", -F.log1p(-F.col("u")) / F.col("weight")).filter("at <= most")
            rated = cut_lineage(rated.select("run_id", "stratum", "instruction_id", "u", "k", (F.col("at") / (F.col("at") + 1)).alias("key")), "p1-rated")
            drawn = bottom_k(rated, ["run_id"], "key", ["u", "instruction_id"], "k")
            counts = defaultdict(lambda: np.zeros(len(self.strata), dtype=np.int64))
            for r in bounded_rows(drawn.groupBy("run_id", "stratum").agg(F.count("*").alias("n")), MAX_FITTED, "strata of runs"):
                counts[r["run_id"]][r["stratum"]] = r["n"]
            able = {name: min(self.runs[name]["limit"], sum(int(self.supply[r[1]]) for r in own)) for name, own in by_run.items()}
            if all(int(counts[name].sum()) >= n for name, n in able.items()):
                break
        return counts

    def _with_small(self, left: DataFrame, rows: list[tuple], schema: str, on: list[str]) -> DataFrame:
        """Inner join with strata rows: broadcast up to MAX_BROADCAST of them, beyond that shuffled with hot strata salted."""
        right = self.spark.createDataFrame(rows, schema)
        if len(rows) <= MAX_BROADCAST:
            return left.join(F.broadcast(right), on)
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.withColumn("__salt", F.pmod(F.xxhash64("instruction_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")

    def _repaired(self, counts: dict[str, np.ndarray]) -> DataFrame:
        """Of each stratum of a run the records with the smallest keys, as many as the repaired counts say.

        Within a stratum the order of keys is that of ``u``; again only what nearly surely suffices goes on, else all.
        """
        final = []
        for name, run in self.runs.items():
            goals = [(m, t["target_share"] * run["limit"], t["min_count"]) for m, t in run["targets"]]
            taken = repair(counts[name], self.supply, goals, run["limit"])
            final += [(name, j, *self.strata[j], int(n), int(run["seed"]), sure_share(int(n), int(self.supply[j]))) for j, n in enumerate(taken) if n > 0]
        schema = "run_id string, stratum int, task_family string, condition string, category string, take bigint, seed bigint, most double"
        for bounded in (True, False):
            rows = final if bounded else [(*r[:-1], 1.0) for r in final]
            wanted = self._with_small(self.records, rows, schema, ATTRIBUTES).withColumn("u", uniform("seed", "instruction_id")).filter("u <= most")
            wanted = cut_lineage(wanted.select("run_id", "stratum", "instruction_id", "cells", "u", "take"), "p1-wanted")
            sample = cut_lineage(bottom_k(wanted, ["run_id", "stratum"], "u", ["instruction_id"], "take", buckets=256).select("run_id", "instruction_id", "cells"), "p1-sample")
            if not bounded or sample.count() == sum(r[5] for r in final):
                break
        return sample

    def report(self) -> DataFrame:
        """One row per target: need, supply and sampled count, the residual gap, and whether supply is too small for the need."""
        rows = []
        for t in self.targets.values():
            asked = self.runs[t["run_id"]]["asked"]
            need = max(t["target_share"] * (asked or 0), float(t["min_count"]))
            rows.append((t["target_id"], t["run_id"], *(t[a] for a in ATTRIBUTES), float(t["target_share"]), t["min_count"], need, self.runs[t["run_id"]]["limit"]))
        schema = "target_id bigint, run_id string, task_family string, condition string, category string, target_share double, min_count bigint, need double, run_limit bigint"
        targets = self.spark.createDataFrame(rows, schema)
        supplied = count_by_target(self.records, targets, []).withColumnRenamed("matched", "supply")
        sampled = count_by_target(self.sample, targets.select("target_id", "run_id", *ATTRIBUTES), ["run_id"]).select("target_id", F.col("matched").alias("sampled"))
        shown = [F.nullif(F.col(a), F.lit(ANY)).alias(a) for a in ATTRIBUTES]
        return (
            supplied.join(sampled, "target_id")
            .withColumn("gap", F.greatest(F.col("need") - F.col("sampled"), F.lit(0.0)))
            .withColumn("share", F.coalesce(F.try_divide(F.col("sampled").cast("double"), F.col("run_limit").cast("double")), F.lit(0.0)))
            .withColumn("unmeetable", (F.col("gap") > 0) & (F.col("need") > F.col("supply")))
            .select("target_id", "run_id", *shown, "target_share", "min_count", "need", "supply", "sampled", "share", "gap", "unmeetable")
        )
