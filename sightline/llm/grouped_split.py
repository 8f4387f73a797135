"""Splits that keep related records together.

*Groups.* Images and what they share (a computed digest, a capture session of a category) form a bipartite graph, whose nodes are
64-bit hashes, checked for collisions. Labels start as the nodes themselves. In every round an entity takes the smallest label of its images and an
image the smallest of its entities, and the graph is contracted: images give way to their labels, and entities with a single label left, which link
nothing more, are dropped. So finished groups leave at once, and as hashes are random the graph shrinks by a constant factor a round, chains too.
An entity with many images is split into parts of at most ``PART`` images: its label is sent to every part, so no task holds a hot entity. In the end
labels are followed through the rounds.

*Splits.* Groups are given out where they can least be made up for first, each step knowing what all earlier ones left of every stratum (category x
condition): the ``BLOCK`` largest groups one by one, largest first, to the split where the deviation over all their strata grows least; then smaller groups
that hold several strata, and at last those of a single one. The latter two are ordered by hash within their rarest stratum and cut by running record
counts at what is left of each split's share. As groups of one stratum come last, what the others left uneven is made up for, and a stratum ends
within about one small group of the wanted counts wherever it has enough of them; ``split_report`` tells. Groups without records follow their hash.

Defined results: blank or null image identifiers are ignored; missing, malformed and all-zero digests and sessions without a category
link nothing; null splits are ignored; an image known only from instructions is a node of its own; repeated rows
change nothing; a record of images in several groups counts in each; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform
from sightline.functions.text import canonical_id, canonical_split, canonical_token
from sightline.operators.ranking import running_sum
from sightline.storage import bounded_rows, cut_lineage

#: One bit per split.
SPLIT_BITS = {"train": 1, "validation": 2, "test": 4}
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
PART = 50_000
BLOCK = 20_000
SALTS = 16
MAX_STRATA = 200_000
NO_STRATUM = "|"


def image_links(images: DataFrame) -> DataFrame:
    """(image_id, entity) links; may repeat."""
    digest = canonical_id("sha256")
    session = F.concat(F.lit("c:"), canonical_token("category"), F.lit("|"), canonical_id("capture_session"))
    known = digest.rlike("^[0-9a-f]{64}$") & (digest != "0" * 64)
    rows = images.select(canonical_token("image_id").alias("image_id"), F.array(F.when(known, F.concat(F.lit("s:"), digest)), session).alias("entities"))
    return rows.filter("image_id IS NOT NULL").select("image_id", F.explode("entities").alias("entity")).filter("entity IS NOT NULL")


def _hashed(links: DataFrame) -> tuple[DataFrame, int]:
    """Distinct (node, entity) links as hashes under a seed that keeps all identifiers apart, and the seed."""
    for seed in range(8):
        h = lambda c, salt: F.xxhash64(F.col(c), F.lit(salt))  # noqa: B023, E731
        both = links.select(h("image_id", seed).alias("node"), h("entity", seed).alias("entity"), h("image_id", seed + 100).alias("c1"), h("entity", seed + 100).alias("c2"))
        both = cut_lineage(both.distinct(), "p4-links")
        each = both.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("node").alias("h"), F.col("c1").alias("c")), F.struct(F.lit(1).alias("side"), F.col("entity").alias("h"), F.col("c2").alias("c")))).alias("x"))
        if each.groupBy("x.side", "x.h").agg(F.min("x.c").alias("a"), F.max("x.c").alias("b")).filter("a <> b").isEmpty():
            return both.select("node", "entity"), seed
    raise RuntimeError("hashes collide under all seeds")


def _labels(links: DataFrame, part: int) -> DataFrame:
    """(node, label) of every node that shares an entity. ``links``: distinct (node, entity)."""
    degree = links.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    state = links.join(degree, "entity").select(F.col("node").alias("new"), "entity", "parts")
    rounds = []
    while True:
        found = state.groupBy("entity", "parts").agg(F.min("new").alias("found"), F.max("new").alias("most")).filter("found < most")
        sent = found.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "found")
        links = state.select(F.col("new").alias("node"), "entity", "parts").withColumn("part", F.pmod("node", F.col("parts")).cast("int"))
        reached = cut_lineage(links.join(sent, ["entity", "part"]).drop("part").distinct(), "p4-reached")
        if reached.isEmpty():
            break
        lowest = reached.groupBy("node").agg(F.min("found").alias("new"))
        state = cut_lineage(reached.drop("found").join(lowest, "node"), "p4-round")
        rounds.append(state.select("node", "new").distinct())
        state = state.select("new", "entity", "parts")
    if not rounds:
        return links.select("node", F.col("node").alias("label")).filter("false")
    # labels of later rounds are few; those of the first are followed from the last round on, and hot ones are salted
    follow = None
    for later in reversed(rounds[1:]):
        step = later.select(F.col("node").alias("new"), F.col("new").alias("label"))
        follow = step if follow is None else step.join(follow.select(F.col("new").alias("label"), F.col("label").alias("next")), "label", "left").select("new", F.coalesce("next", "label").alias("label"))
    if follow is None:
        return rounds[0].select("node", F.col("new").alias("label"))
    salted = follow.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rounds[0].withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(salted, ["new", "salt"], "left").select("node", F.coalesce("label", "new").alias("label"))


def components(links: DataFrame, part: int = PART) -> DataFrame:
    """(image_id, group_id) for every image that shares an entity; group_id is the smallest image_id of its group. ``links``: (image_id, entity)."""
    hashed, seed = _hashed(links)
    labels = _labels(hashed, part)
    named = links.select("image_id").distinct().withColumn("node", F.xxhash64("image_id", F.lit(seed))).join(labels, "node").select("image_id", "label")
    return named.join(named.groupBy("label").agg(F.min("image_id").alias("group_id")), "label").select("image_id", "group_id")


def _split_bits() -> Column:
    return sum((F.when(canonical_split("dataset_split") == s, F.lit(b)).otherwise(F.lit(0)) for s, b in SPLIT_BITS.items()), F.lit(0))


def image_records(instructions: DataFrame) -> DataFrame:
    """Per image its distinct records and its stratum, of the alphabetically last category and condition.

    Deliveries are folded by hashes of image and record, numbers all, so that both steps aggregate by hash.
    """
    category, condition = canonical_token("metadata.category"), canonical_token("metadata.condition")
    rows = instructions.select(canonical_token("image_id").alias("image_id"), F.xxhash64(canonical_id("instruction_id"), F.lit(1)).alias("record"), canonical_id("instruction_id").isNotNull().alias("is_record"), category.alias("category"), condition.alias("condition")).filter("image_id IS NOT NULL")
    strata = rows.select("image_id", "category", "condition").distinct().groupBy("image_id").agg(F.concat_ws("|", F.coalesce(F.max("category"), F.lit("")), F.coalesce(F.max("condition"), F.lit(""))).alias("stratum"))
    counts = rows.filter("is_record").select("image_id", "record").distinct().groupBy("image_id").agg(F.count("*").alias("records"))
    return strata.join(counts, "image_id", "left")


class RelatedImages:
    """Groups of related images with what their instruction records carry."""

    def __init__(self, images: DataFrame, instructions: DataFrame, part: int = PART) -> None:
        self.spark, self.instructions = images.sparkSession, instructions
        hashed, seed = _hashed(image_links(images))
        known = images.select(canonical_token("image_id").alias("image_id"), F.lit(0).alias("bits"))
        carried = instructions.select(canonical_token("image_id").alias("image_id"), _split_bits().alias("bits"))
        nodes = known.unionByName(carried).filter("image_id IS NOT NULL").groupBy("image_id").agg(F.bit_or("bits").alias("bits")).withColumn("node", F.xxhash64("image_id", F.lit(seed)))
        self.nodes = cut_lineage(nodes.join(_labels(hashed, part), "node", "left").select("image_id", "bits", F.coalesce("label", "node").alias("group")), "p4-images")

    def scattered(self) -> DataFrame:
        """Every image of a group whose records carry more than one split today."""
        mixed = self.nodes.groupBy("group").agg(F.bit_or("bits").alias("bits")).filter(F.bit_count("bits") > 1)
        return self.nodes.join(mixed.select("group"), "group", "left_semi").select("image_id")

    def assign(self, ratios: dict[str, float] = RATIOS, seed: int = 42, block: int = BLOCK) -> DataFrame:
        """(image_id, group_id, records, stratum, split): one split per group, near ``ratios`` in all and in each stratum."""
        nodes = self.nodes.join(image_records(self.instructions), "image_id", "left")
        nodes = cut_lineage(nodes.select("image_id", "group", F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), F.coalesce("stratum", F.lit(NO_STRATUM)).alias("stratum")), "p4-counted")
        parts = nodes.filter("records > 0").groupBy("group", "stratum").agg(F.sum("records").alias("records"))
        totals = bounded_rows(parts.groupBy("stratum").agg(F.sum("records").alias("n")), MAX_STRATA, "strata")
        totals = sorted(totals, key=lambda r: (r["n"], r["stratum"]))  # rarest first
        ranks = self.spark.createDataFrame([(r["stratum"], i) for i, r in enumerate(totals)], "stratum string, rank int")
        parts = cut_lineage(parts.join(F.broadcast(ranks), "stratum").drop("stratum"), "p4-parts")  # at most MAX_STRATA short rows
        groups = parts.groupBy("group").agg(F.sum("records").alias("size"), F.min("rank").alias("rank"), F.count("*").alias("strata"))
        groups = cut_lineage(groups.withColumn("u", uniform(F.lit(seed), "group")), "p4-groups")
        first = cut_lineage(groups.orderBy(F.desc("size"), "group").limit(block).select("group"), "p4-largest")
        own = parts.join(first, "group", "left_semi").withColumn("one", F.lit(1))  # BLOCK groups with their strata
        placed = cut_lineage(own.groupBy("one").applyInArrow(_largest_first(ratios), "group bigint, split string"), "p4-placed")
        rest = groups.join(first, "group", "left_anti")
        for several in (True, False):
            todo = rest.filter("strata > 1" if several else "strata = 1")
            left = {i: {x: share * r["n"] for x, share in ratios.items()} for i, r in enumerate(totals)}
            for r in bounded_rows(parts.join(placed, "group").groupBy("rank", "split").agg(F.sum("records").alias("n")), MAX_STRATA * len(ratios), "strata of splits"):
                left[r["rank"]][r["split"]] -= r["n"]
            cuts = self.spark.createDataFrame([(i, _cuts(list(needs.values()), list(ratios.values()))) for i, needs in left.items()], "rank int, cuts array<double>")
            placed = cut_lineage(placed.unionByName(_cut(todo, cuts, list(ratios))), "p4-placed")
        u, upto, by_hash = uniform(F.lit(seed), "group"), 1.0, F.lit(None).cast("string")
        for name in reversed(list(ratios)):
            by_hash = F.when(u < upto, F.lit(name)).otherwise(by_hash)
            upto -= ratios[name]
        names = nodes.groupBy("group").agg(F.min("image_id").alias("group_id"))
        splits = names.join(placed, "group", "left").select("group", "group_id", F.coalesce("split", by_hash).alias("split"))
        return nodes.join(splits, "group").select("image_id", "group_id", "records", "stratum", "split")


def _cuts(needs: list[float], ratios: list[float]) -> list[float]:
    """Where in [0, 1] the groups of a stratum pass from one split to the next, so that each gets what it still needs."""
    needs = [max(n, 0.0) for n in needs]
    needs = needs if sum(needs) > 0 else ratios
    return [sum(needs[: i + 1]) / sum(needs) for i in range(len(needs) - 1)]


def _cut(groups: DataFrame, cuts: DataFrame, names: list[str]) -> DataFrame:
    """(group, split): groups ordered by hash in their rarest stratum and cut by the records before them."""
    groups = cut_lineage(groups, "p4-todo")
    sums = groups.groupBy("rank").agg(F.sum("size").alias("sum"))
    placed = running_sum(groups, ["rank"], "u", ["group"], "size", "before", buckets=256).join(F.broadcast(sums), "rank").join(F.broadcast(cuts), "rank")  # a row per stratum
    at, split = (F.col("before") + F.col("size") / 2) / F.col("sum"), F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(at < F.col("cuts")[i], F.lit(names[i])).otherwise(split)
    return placed.select("group", split.alias("split"))


def _largest_first(ratios: dict[str, float]):
    """Gives groups, largest first, to the split where the deviation of their strata from the wanted shares grows least.

    Shares are of what is given out so far, so that strata are even whenever the groups end. The deviation over all strata decides only between splits that are
    nearly as good: what one huge group leaves uneven is for its own stratum to make up for.
    """

    def run(table: pa.Table) -> pa.Table:
        counts: dict[int, dict[int, int]] = defaultdict(dict)
        for group, stratum, n in zip(*(table.column(c).to_pylist() for c in ("group", "rank", "records"))):
            counts[group][stratum] = n
        given: dict[int, int] = defaultdict(int)  # -1: all strata
        held = {x: defaultdict(int) for x in ratios}
        groups, splits = [], []
        for group in sorted(counts, key=lambda g: (-sum(counts[g].values()), g)):
            own = [*counts[group].items(), (-1, sum(counts[group].values()))]
            for s, n in own:
                given[s] += n
            best = min(ratios, key=lambda x: sum((2 * (held[x][s] - ratios[x] * given[s]) + n) * n / given[s] * (1e-3 if s < 0 else 1.0) for s, n in own))
            for s, n in own:
                held[best][s] += n
            groups.append(group)
            splits.append(best)
        return pa.table({"group": pa.array(groups, pa.int64()), "split": pa.array(splits, pa.string())})

    return run


def split_report(assigned: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Per stratum and split, and in all (stratum null): records, their share, how far they are from the wanted number, and the records of the largest group that holds the stratum."""
    parts = cut_lineage(assigned.groupBy("stratum", "split", "group_id").agg(F.sum("records").alias("records")), "p4-parts")
    sizes = parts.groupBy("group_id").agg(F.sum("records").alias("size"))
    rows = parts.join(sizes, "group_id").groupBy("stratum", "split").agg(F.sum("records").alias("records"), F.max("size").alias("largest"))
    rows = cut_lineage(rows, "p4-cells")  # strata times splits
    rows = rows.unionByName(rows.groupBy("split").agg(F.sum("records").alias("records"), F.max("largest").alias("largest")).withColumn("stratum", F.lit(None).cast("string")))
    spine = rows.groupBy("stratum").agg(F.sum("records").alias("whole"), F.max("largest").alias("largest_group"))
    spine = spine.select("stratum", "whole", "largest_group", F.explode(F.create_map(*(x for k, v in ratios.items() for x in (F.lit(k), F.lit(v))))).alias("split", "wanted"))
    both = spine.join(rows.select(F.col("stratum").alias("s"), F.col("split").alias("x"), "records"), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("split") == F.col("x")), "left")
    records = F.coalesce("records", F.lit(0).cast("bigint"))
    share = F.coalesce(F.try_divide(records.cast("double"), F.col("whole").cast("double")), F.lit(0.0))
    return both.select("stratum", "split", records.alias("records"), share.alias("share"), F.abs(records - F.col("wanted") * F.col("whole")).alias("deviation"), "largest_group")
