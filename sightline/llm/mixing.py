"""Sources combined to target weights along a curriculum.

A plan asks for ``target_share`` of the total token size T of all documents from each source, each document at most
``max_repeats`` times. The weight of a source changes over training time t in [0, 1]: it starts nearer to the source's natural
share and ends as far on the other side, ``w(t) = share + a (1 - 2 t)``, so that its integral ``W(t) = share t + a (t - t^2)`` is
``share`` at the end and weights add up to 1 at any time. ``a`` is ``strength`` times the distance from the natural share,
lowered per plan so that no weight falls below 0; strength 0 keeps weights constant.

Documents of a source have a fixed random order. One with cumulative demand x in its source (repetition times source
size plus the tokens before it plus half its own) is taken while x is below share T, and gets the position where W reaches x / T.
The result is sorted by range on (plan, position). Cumulative sums are taken per bucket of the order, never per whole source.

Defined results: sources are canonical; documents without a source or doc_id count in T but can't be taken; empty texts have size 0 and no place
in a mix; null or negative shares count as 0, null max_repeats as 1; repeated plan rows count once, the largest values winning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform
from sightline.functions.text import canonical_token
from sightline.operators.ranking import running_sum
from sightline.storage import bounded_rows, cut_lineage

MAX_PLAN_ROWS = 20_000
STRENGTH = 0.5


class SourceMix:
    """``sizes``: doc_id, source, tokens; ``plan``: plan_id, source, target_share, max_repeats."""

    def __init__(self, sizes: DataFrame, plan: DataFrame, strength: float = STRENGTH, seed: int = 42) -> None:
        self.spark = sizes.sparkSession
        docs = cut_lineage(sizes.select("doc_id", canonical_token("source").alias("source"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), uniform(F.lit(seed), "doc_id").alias("u")), "p6-sizes")
        rows = plan.filter("plan_id IS NOT NULL").select("plan_id", canonical_token("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("repeats"))
        rows = rows.filter("source IS NOT NULL").groupBy("plan_id", "source").agg(F.max("share").alias("share"), F.max("repeats").cast("int").alias("repeats"))
        usable = docs.filter("source IS NOT NULL AND doc_id IS NOT NULL AND tokens > 0")
        sums = usable.groupBy("source").agg(F.sum("tokens").alias("size"))
        planned = bounded_rows(rows.join(sums, "source", "left"), MAX_PLAN_ROWS, "plan")
        self.total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self.plan = self.spark.createDataFrame(self._scheduled(planned, strength), "plan_id string, source string, share double, repeats int, size bigint, bend double")
        ordered = running_sum(usable.join(F.broadcast(self.plan.select("source").distinct()), "source", "left_semi"), ["source"], "u", ["doc_id"], "tokens", "before")
        each = ordered.join(F.broadcast(self.plan), "source")  # the plan has at most MAX_PLAN_ROWS rows
        total = F.lit(float(max(self.total, 1)))
        # later repetitions lie beyond the source's share of the demand, so they aren't even spread
        useful = F.least(F.col("repeats"), F.ceil(F.col("share") * total / F.col("size")) + 1).cast("int")
        each = each.filter("repeats > 0").withColumn("repetition", F.explode(F.sequence(F.lit(0), useful - 1)))
        reached = (F.col("repetition") * F.col("size") + F.col("before") + F.col("tokens") / 2) / total
        slope = F.col("share") + F.col("bend")
        position = 2 * F.col("y") / (slope + F.sqrt(F.greatest(slope * slope - 4 * F.col("bend") * F.col("y"), F.lit(0.0))))
        taken = each.withColumn("y", reached).filter(F.col("y") < F.col("share"))
        self.taken = cut_lineage(taken.select("plan_id", F.least(position, F.lit(1.0)).alias("position"), "source", "doc_id", "repetition", "tokens"), "p6-mix")

    @staticmethod
    def _scheduled(planned: list, strength: float) -> list[tuple]:
        """Adds to each plan row the bend of its weight."""
        out = []
        for plan_id in sorted({r["plan_id"] for r in planned}):
            own = [r for r in planned if r["plan_id"] == plan_id]
            all_sizes, all_shares = sum(r["size"] or 0 for r in own), sum(r["share"] for r in own)
            away = {r["source"]: (all_shares * (r["size"] or 0) / all_sizes - r["share"]) if all_sizes else 0.0 for r in own}
            most = min([strength, *(r["share"] / away[r["source"]] for r in own if away[r["source"]] > 0)])
            out += [(plan_id, r["source"], float(r["share"]), int(r["repeats"]), int(r["size"] or 0), float(most * away[r["source"]])) for r in own]
        return out

    def sequence(self) -> DataFrame:
        """The training order of every plan: (plan_id, position, source, doc_id, repetition, tokens)."""
        return self.taken.repartitionByRange("plan_id", "position").sortWithinPartitions("plan_id", "position", "doc_id", "repetition")

    def report(self) -> DataFrame:
        """Per plan row: wanted and taken tokens, documents, the actual share of the mix, and whether the source falls short."""
        got = self.taken.groupBy("plan_id", "source").agg(F.sum("tokens").alias("taken"), F.count("*").alias("documents"))
        whole = got.groupBy("plan_id").agg(F.sum("taken").alias("mixed"))
        rows = self.plan.join(got, ["plan_id", "source"], "left").join(whole, "plan_id", "left")
        wanted, possible = F.col("share") * F.lit(float(self.total)), F.col("size") * F.col("repeats")
        taken = F.coalesce("taken", F.lit(0))
        return rows.select(
            "plan_id", "source", F.col("share").alias("target_share"), "repeats", wanted.alias("wanted"), possible.alias("possible"), taken.alias("taken"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce(F.try_divide(taken.cast("double"), F.col("mixed").cast("double")), F.lit(0.0)).alias("actual_share"), ((taken >= possible) & (possible < wanted)).alias("short"),
        )
