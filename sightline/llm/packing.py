"""Items of varying length in containers of fixed capacity.

Hierarchical residual packing. Documents above the capacity are cut into full pieces and a rest; a full piece is a container.
All other pieces are spread by hash over tasks of about ``TASK_ITEMS`` pieces, and each task packs best-fit, largest first.
Containers filled to ``FULL`` are done. The others become items themselves (their content moves as one) for the next
round, with ``FAN_IN`` times fewer tasks, until one task holds all that is left of a capacity or rounds stop helping.
No task gets more than about ``TASK_ITEMS`` items; within a round the spread doesn't depend on the order of rows.

Defined results: rows without doc_id are ignored; repeated doc_ids count once with their largest size; an empty text takes one
unit of room but adds no tokens; capacities that are null or below 1 are ignored; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.storage import bounded_rows, cut_lineage

TASK_ITEMS = 20_000
FAN_IN = 8
FULL = 0.98
MAX_CAPACITIES = 1_000
BIN_SCHEMA = "capacity_tokens bigint, container string, room bigint, members array<struct<doc_id:bigint,piece:bigint,tokens:bigint>>"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item and the number of bins: each item, largest first, goes where the least room is left over."""
    open_bins: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins = np.empty(len(sizes), dtype=np.int64)
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        if room > size:
            insort(open_bins, (room - size, b))
    return bins, count


def _pack_group(table: pa.Table) -> pa.Table:
    """Packs the items of one task and capacity; the content of items that share a bin is joined."""
    table = table.sort_by([("container", "ascending")]).combine_chunks()
    capacity = table.column("capacity_tokens")[0].as_py()
    room = table.column("room").to_numpy()
    bins, count = best_fit(room, capacity)
    order = np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(count))
    members = table.column("members").take(pa.array(order)).combine_chunks()
    members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
    lengths = np.add.reduceat(members.value_lengths().to_numpy(zero_copy_only=False), starts)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    names = table.column("container").take(pa.array(order[starts]))
    return pa.table(
        {
            "capacity_tokens": pa.array(np.full(count, capacity, dtype=np.int64)),
            "container": names.cast(pa.string()),
            "room": pa.array(np.add.reduceat(room[order], starts).astype(np.int64)),
            "members": pa.ListArray.from_arrays(pa.array(offsets), members.flatten()),
        }
    )


def pieces(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity_tokens, doc_id, piece, tokens): whole documents, or the pieces of those above the capacity."""
    docs = sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("tokens", F.lit(0))).alias("all"))
    each = docs.withColumn("capacity_tokens", F.explode(F.array(*(F.lit(c).cast("bigint") for c in capacities))))
    last = F.greatest(F.ceil(F.col("all") / F.col("capacity_tokens")), F.lit(1)) - 1
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    left = F.col("all") - F.col("piece") * F.col("capacity_tokens")
    return cut.select("capacity_tokens", "doc_id", "piece", F.least(left, F.col("capacity_tokens")).alias("tokens"))


def pack(sizes: DataFrame, containers: DataFrame, task_items: int = TASK_ITEMS, full: float = FULL) -> DataFrame:
    """Placements (capacity_tokens, container, doc_id, piece, tokens) of documents (doc_id, tokens) for each capacity of ``containers``."""
    rows = bounded_rows(containers.select(F.col("capacity_tokens").cast("bigint").alias("c")).filter("c >= 1").distinct(), MAX_CAPACITIES, "capacities")
    spark, capacities = sizes.sparkSession, sorted(r["c"] for r in rows)
    if not capacities:
        return spark.createDataFrame([], "capacity_tokens bigint, container string, doc_id bigint, piece bigint, tokens bigint")
    name = F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.col("piece").cast("string"))
    items = pieces(sizes, capacities).select("capacity_tokens", name.alias("container"), F.greatest("tokens", F.lit(1)).alias("room"), F.array(F.struct("doc_id", "piece", "tokens")).alias("members"))
    bins = cut_lineage(items, "p5-items")
    done = [bins.filter("room = capacity_tokens")]
    left = bins.filter("room < capacity_tokens")
    tasks, before, turn = None, None, 0
    while True:
        most = left.groupBy("capacity_tokens").count().agg(F.max("count")).first()[0] or 0
        if not most or (before is not None and (tasks == 1 or (turn > 2 and most > 0.99 * before and -(-most // task_items) >= tasks))):
            break
        needed = max(1, -(-most // task_items))
        tasks = needed if tasks is None else max(needed, -(-tasks // FAN_IN))
        spread = left.withColumn("task", F.pmod(F.xxhash64("container", F.lit(turn)), F.lit(tasks)))
        packed = cut_lineage(spread.groupBy("capacity_tokens", "task").applyInArrow(lambda t: _pack_group(t.drop_columns(["task"])), BIN_SCHEMA), f"p5-round{turn}")
        filled = F.col("room") >= F.lit(full) * F.col("capacity_tokens")
        done.append(packed.filter(filled))
        left = packed.filter(~filled)
        before, turn = most, turn + 1
    out = left
    for d in done:
        out = out.unionByName(d)
    return out.select("capacity_tokens", "container", F.explode("members").alias("m")).select("capacity_tokens", "container", "m.doc_id", "m.piece", "m.tokens")


def split_documents(placed: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id) of documents that had to be split."""
    return placed.groupBy("capacity_tokens", "doc_id").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("capacity_tokens", "doc_id")


def fill_report(placed: DataFrame) -> DataFrame:
    """Containers, tokens and the filled share per capacity."""
    each = placed.groupBy("capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"))
    sums = each.groupBy("capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
