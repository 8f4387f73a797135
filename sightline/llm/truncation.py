"""Texts that end before their content does.

A backward character n-gram model, trained on every distinct text, says how often a final context (the last 4 to 24 characters,
read backwards from the end) is followed by an end and how often by more text. An end is the end of a text or a
sentence stop before a blank; inside an open JSON object only the end of the text counts. Orders are interpolated, and the log-odds
of "end" are compared with a threshold per language and column that lies in the valley between the two modes of all log-odds (see ``valley``).

A text is judged by other texts: what is delivered again doesn't count again, and texts that are equal
but for the marks behind them (``alike``) are left out of each other's counts. So a cut text that was delivered again never teaches the model that it
ends there. Only what several records say, such as labels and fixed answers, is evidence for itself: a text counts once for each of its records (within a tenth). Where rows
don't tell their record, copies beyond ``REDELIVERED``, the number that redelivery alone may make, count each.

How it scales. Texts are made distinct first, with a map-side combine; every later pass reads the distinct ones. One pass reduces each to its
final context. The counting pass then only keeps contexts that are some text's final one: it looks them up in a bit table sized by
the number of endings (up to ``MOST_BITS``; false hits cost time, not results), so what is shuffled follows the number of distinct endings rather than the
number of characters. The table is put together by slices, in groups; the driver and every worker hold MOST_BITS / 8 bytes at most. Verdicts are found per distinct
ending, go to the distinct texts and come back to the rows by a shuffled semi-join on the text's hash and length.

Before judging an ending, marks put behind a cut (ellipsis, ``[cut]``, a broken character and the like), blanks, a closing
fence, signature lines and bracketed references are removed, as often as there are any. A mark is evidence of its own: it adds the log of how much
rarer marks are behind endings that are surely ends than behind surely cut ones in the column (see ``mark_evidence``).

Defined results: null and blank texts are never cut; texts count in any role of user, assistant and prediction, each part by
itself; rows without a key are ignored; repeated rows give one case per key; a text of marks only is judged like one without context.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import canonical_id, canonical_token
from sightline.storage import cut_lineage

ORDERS = (4, 8, 12, 18, 24)
PAD = "\x02"
WIDTH = max(ORDERS)
#: Bits of the table of final contexts: SPREAD for each context, a power of two between these; 16 MB at most.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27
SPREAD = 16
#: Bits of a slice of the table, the unit in which tables of tasks are put together.
SLICE = 1 << 18
FLUSH_CHARS = 1_500_000
#: Copies up to which a text counts once where rows don't tell their record, as redelivery may have made them.
REDELIVERED = 16
SMOOTHING = 1.0
#: Where a (language, column) has too few texts or no valley.
DEFAULT_THRESHOLD = -1.5
LOWEST, HIGHEST = -4.5, 0.0
#: How far from its threshold an ending is surely cut, or surely an end, when the evidence of marks is counted; and the most that a mark may add.
SURE, MOST_EVIDENCE = 1.0, 6.0
#: Characters of a text's end that are normalised to get its final context; more if they shrink too much.
REACH = 96

#: Marks that systems put behind a cut.
CUT_WORDS = ["cut", "eof", "eot", "truncated", "snip", "more", "continued", "end of file", "abgeschnitten", "gekürzt", "cortado", "coupé", "tronqué"]
CUT_SIGNS = "…\ufffd\\"
#: How signature lines and bracketed references begin.
SIGNATURES = ["--", "—", "signed", "signature", "gez", "firmado", "signé"]
REFERENCES = ["ref", "no", "id", "see", "siehe", "réf"]
_REFERENCE = re.compile(rf"(?:{'|'.join(REFERENCES)})\b", re.I)
_CLOSERS = "\"'”’)]"

#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to is in that for with was on be this by not as at it from are or an",
    "de": "der die und das ist nicht mit den von zu ein eine auf im dem wurde auch bei aus des",
    "es": "el la los las de que y en un una por con para se del es no al lo su",
    "fr": "le la les des et est une du dans pour qui sur au pas par ce il ne sont avec",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALIKE = {ord(c): "0" for c in "123456789"} | {ord(c): " " for c in "\n\r\t\u00a0"}
_ZEROS, _BLANKS = re.compile("0{2,}"), re.compile(" {2,}")


def language(text: str) -> str:
    """The language whose function words the text holds most of; en on a tie."""
    words = set(text.lower().split())
    return max(_WORDS, key=lambda k: (len(words & _WORDS[k]), k == "en"))


def _bracketed(t: str, opening: str) -> tuple[str, int] | None:
    """What the brackets at the end of ``t`` hold, without further brackets, and where they open."""
    at = max(t.rfind(c, 0, len(t) - 1) for c in opening)
    inner = t[at + 1 : -1]
    return None if at < 0 or any(c in inner for c in "])>") else (inner.strip(), at)


def trimmed(text: str) -> tuple[str, bool]:
    """The text without what follows its content, and whether a mark of a cut was there.

    Goes on until nothing is left to remove. Signatures and references before a mark stay: they are what was cut.
    """
    marked, t = False, text.replace(PAD, " ").rstrip()
    while t:
        last = t[-1]
        if last in CUT_SIGNS or t.endswith("..."):
            marked, t = True, t.rstrip("." if last == "." else CUT_SIGNS).rstrip()
            continue
        if last == "`":
            t = t.rstrip("`").rstrip()
            continue
        if last in ")]>" and (found := _bracketed(t, "([<")):
            if found[0].lower() in CUT_WORDS:
                marked, t = True, t[: found[1]].rstrip()
                continue
            if last != ">" and not marked and "\n" not in found[0] and _REFERENCE.match(found[0]):
                t = t[: found[1]].rstrip()
                continue
        line = t.rfind("\n")
        if marked or line < 0 or not t[line + 1 : line + 64].lstrip().lower().startswith(tuple(SIGNATURES)):
            break
        t = t[:line].rstrip()
    return t, marked


def body_of(text: str) -> tuple[str, bool, bool]:
    """The text up to its last character that isn't a stop, whether a JSON object is open there, and whether a mark follows."""
    t, marked = trimmed(text)
    inside = t.count("{") > t.count("}")
    if not inside:
        open_ = t.rstrip(_CLOSERS)
        shorter = open_.rstrip(".!?")
        t = shorter if len(shorter) < len(open_) else t
    return t, inside, marked


def _alike(text: str) -> str:
    """Lower case, digits as 0 and blanks as a space, runs of either as one."""
    return _BLANKS.sub(" ", _ZEROS.sub("0", text.translate(_ALIKE).lower()))


def _codes(joined: str) -> np.ndarray:
    """The characters of ``_alike`` as numbers."""
    return np.frombuffer(_alike(joined).encode("utf-32-le"), dtype=np.uint32)


def _tail(body: str) -> str:
    """The last WIDTH normalised characters, padded at a text's start."""
    if len(body) > REACH:
        end = _alike(body[-REACH:])
        if len(end) > WIDTH:  # the first character may belong to a run that starts earlier
            return end[-WIDTH:]
    return (PAD * WIDTH + _alike(body))[-WIDTH:]


def final_context(text: str) -> tuple[str, bool, bool]:
    """The last WIDTH normalised characters, whether a JSON object is open there, and the mark."""
    body, inside, marked = body_of(text)
    return _tail(body), inside, marked


def _hashed(a: np.ndarray, at: np.ndarray, salt: np.ndarray, keep=None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order k the positions among ``at`` (at least WIDTH - 1) that are left, and the hash of the k characters ending there.

    ``keep`` tells which hashes are wanted; as a final context's shorter contexts are final ones too, a position that is dropped at
    one order is dropped at all longer ones, and long hashes are only put together where they are needed.
    """
    base = 0x9E3779B97F4A7C15
    power = {k: np.uint64(pow(base, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}
    out = {}
    with np.errstate(over="ignore"):
        one = (a.astype(np.uint64) + np.uint64(0x632BE5AB)) * np.uint64(0xBF58476D1CE4E5B9)
        two = one.copy()
        two[1:] += one[:-1] * power[1]
        four = two.copy()
        four[2:] += two[:-2] * power[2]
        eight = lambda i: four[i] + four[i - 4] * power[4]
        sixteen = lambda i: eight(i) + eight(i - 8) * power[8]
        parts = {4: lambda i: four[i], 8: eight, 12: lambda i: four[i] + eight(i - 4) * power[4], 18: lambda i: two[i] + sixteen(i - 2) * power[2], 24: lambda i: eight(i) + sixteen(i - 8) * power[8]}
        for k in ORDERS:
            h = _mixed(_mixed(parts[k](at) ^ np.uint64(k * 0x51ED270B)) ^ salt)
            if keep is not None:
                hit = keep(h)
                at, salt, h = at[hit], salt[hit], h[hit]
            out[k] = (at, h)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _salt(column: str, inside: np.ndarray | bool) -> np.ndarray:
    """Keeps columns and the inside of JSON apart."""
    c = np.uint64(int.from_bytes(column.encode()[:8].ljust(8, b"\0"), "little"))
    return np.where(inside, c ^ np.uint64(0xD1B54A32D192ED03), c).astype(np.uint64)


def _contexts(tails: list[str], columns: list[str], inside: list[bool]) -> dict[int, np.ndarray]:
    """Hashes of final contexts, one per tail and order; equal to those of the counting pass."""
    a = np.frombuffer("".join(tails).encode("utf-32-le"), dtype=np.uint32)
    last = np.arange(1, len(tails) + 1) * WIDTH - 1
    salts = {c: (_salt(c, False), _salt(c, True)) for c in set(columns)}
    salt = np.array([salts[c][j] for c, j in zip(columns, inside)], dtype=np.uint64)
    return {k: h for k, (_, h) in _hashed(a, last, salt).items()} if tails else {k: np.array([], dtype=np.uint64) for k in ORDERS}


def _at(h: np.ndarray, size: int) -> np.ndarray:
    """The place of each hash in a table of ``size`` bits."""
    return (h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set; ``bits``: packed, eight to a byte."""
    at = _at(h, len(bits) * 8)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _count(column: str, texts: list[str], weights: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, ends, occurrences) of a batch of distinct texts, for contexts in the bit table only."""
    parts = [body_of(t)[0] for t in texts]
    a = _codes(PAD * WIDTH + (PAD * WIDTH).join(parts) + PAD * WIDTH)
    pad = a == ord(PAD)
    is_end = np.zeros(len(a), dtype=bool)
    is_end[:-1] = ~pad[:-1] & pad[1:]
    depth = np.cumsum((a == 123).astype(np.int32) - (a == 125).astype(np.int32))
    first = np.concatenate([[False], pad[:-1] & ~pad[1:]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    inside = depth - depth[np.maximum(start - 1, 0)] > 0
    stop = (a == 46) | (a == 33) | (a == 63)
    boundary = np.zeros(len(a), dtype=bool)
    boundary[:-2] = stop[1:-1] & (a[2:] == 32) & ~inside[:-2] & ~stop[:-2]
    ends = is_end | boundary
    # blank texts leave no position, so texts are numbered by the runs of their characters
    number = np.cumsum(first) - 1
    weight = np.array([w for t, w in zip(parts, weights) if t] or [0], dtype=np.int64)
    salt = _salt(column, inside)
    positions = np.flatnonzero(~pad)
    keys, e, n = [], [], []
    for at, x in _hashed(a, positions, salt[positions], lambda h: _known(h, bits)).values():
        w = weight[number[at]]
        keys.append(x)
        e.append(np.where(ends[at], w, 0))
        n.append(w)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(e), len(key)), np.bincount(back, np.concatenate(n), len(key))


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The final context of each distinct text, and a hash of the text without what was put behind it."""
    for b in batches:
        texts = b.column("text").to_pylist()
        bodies = [body_of(t) for t in texts]
        columns = [
            pa.array([xxhash.xxh3_64_intdigest(x[0]) - (1 << 63) for x in bodies], pa.int64()), pa.array([_tail(x[0]) for x in bodies], pa.string()), pa.array([x[1] for x in bodies], pa.bool_()),
            pa.array([x[2] for x in bodies], pa.bool_()), pa.array([language(t) for t in texts], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([b.column("col"), b.column("hash"), b.column("size"), *columns], names=["col", "hash", "size", "body", "tail", "inside", "marked", "lang"])


def _slices(size: int):
    """A mapper that gives the bit table of a task's endings in slices, and a reducer that puts tables of a slice together."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            for h in _contexts(b.column("tail").to_pylist(), b.column("col").to_pylist(), b.column("inside").to_pylist()).values():
                at = _at(h, size)
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = bits.reshape(-1, min(SLICE, size) // 8)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=["slice", "bits"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of one slice."""
        out, number = None, None
        for b in batches:
            for part in b.column("bits").to_pylist():
                part = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
                out, number = (part if out is None else out | part), b.column("slice")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    return own, together


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per final context and order."""
    for b in batches:
        hashes = _contexts(b.column("tail").to_pylist(), b.column("col").to_pylist(), b.column("inside").to_pylist())
        for k, h in hashes.items():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(h), k, dtype=np.int32)), pa.array(h.view(np.int64))], names=[*b.schema.names, "k", "h"])


def valley(histogram: list[tuple[float, float]]) -> float:
    """The log-odds between LOWEST and HIGHEST where endings are rarest: the centre of the window with the fewest texts.

    Ties go to the window nearest to DEFAULT_THRESHOLD; fewer than 50 texts give DEFAULT_THRESHOLD.
    """
    if sum(n for _, n in histogram) < 50:
        return DEFAULT_THRESHOLD
    best = min(
        (sum(n for x, n in histogram if abs(x - at) < 0.5), abs(at - DEFAULT_THRESHOLD), at)
        for at in np.arange(LOWEST, HIGHEST + 0.01, 0.1).tolist()
    )
    return best[2]


def mark_evidence(histogram: list[tuple[bool, float, int]]) -> float:
    """What a mark adds to the log-odds of an end: the log of its rate among sure ends over that among sure cuts, between -MOST_EVIDENCE and 0.

    ``histogram``: (marked, log-odds less threshold, texts).
    """
    ends, cuts = ([(m, n) for m, x, n in histogram if x * side > SURE] for side in (1, -1))
    rate = lambda rows: (sum(n for m, n in rows if m) + 0.5) / (sum(n for _, n in rows) + 1.0)
    return max(-MOST_EVIDENCE, min(0.0, math.log(rate(ends) / rate(cuts))))


IDS = ["col", "lang", "tail", "inside", "marked", "alike"]


class TruncationModel:
    """``texts``: record_kind string, record_key bigint, origin string, col string, text string; and if known, record string, equal for all deliveries of a record."""

    def __init__(self, texts: DataFrame) -> None:
        self.spark = texts.sparkSession
        texts = texts.filter(F.col("record_key").isNotNull() & F.col("text").rlike(r"(?U)\S"))
        hashed = [F.xxhash64("text").alias("hash"), F.length("text").alias("size")]
        self.rows = texts.select("record_kind", "record_key", "origin", "col", *hashed)
        weight = F.greatest(F.count("*") - REDELIVERED + 1, F.lit(1))
        if "record" in texts.columns:
            weight = F.greatest(F.approx_count_distinct("record", 0.1), F.lit(1))  # the same for any number of deliveries
        self.texts = cut_lineage(texts.groupBy("col", "text").agg(weight.cast("bigint").alias("weight")), "p3-texts")
        schema = "col string, hash bigint, size int, body bigint, tail string, inside boolean, marked boolean, lang string"
        endings = cut_lineage(self.texts.select("col", "text", *hashed).mapInArrow(_endings, schema), "p3-endings")
        alike = endings.groupBy("col", "body").agg(F.count("*").alias("alike"))
        self.endings = cut_lineage(endings.join(alike, ["col", "body"]).drop("body"), "p3-alike")
        self.tails = self.endings.groupBy(*IDS).agg(F.count("*").alias("texts"))
        self.scored = cut_lineage(self._scores(self._counts()), "p3-scored")
        self.thresholds, self.marks = self._fitted()

    def _counts(self) -> DataFrame:
        contexts = cut_lineage(self.endings.select("col", "tail", "inside").distinct(), "p3-contexts")
        size = max(LEAST_BITS, min(MOST_BITS, 1 << (SPREAD * len(ORDERS) * contexts.count()).bit_length()))
        own, together = _slices(size)
        bits = np.zeros((size // SLICE, SLICE // 8), dtype=np.uint8)
        slices = contexts.mapInArrow(own, "slice int, bits binary").groupBy("slice").applyInArrow(together, "slice int, bits binary")
        for r in slices.toLocalIterator():  # MOST_BITS / 8 bytes at most
            bits[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
        shared = self.spark.sparkContext.broadcast(bits.tobytes())  # as much

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.frombuffer(shared.value, dtype=np.uint8)
            held: dict[str, tuple[list[str], list[int]]] = {}
            chars = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for column, (texts, weights) in held.items():
                    key, e, n = _count(column, texts, weights, known)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(e.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "e", "n"])
                held.clear()

            for b in batches:
                for column in pc.unique(b.column("col")).to_pylist():
                    mine = pc.equal(b.column("col"), column)
                    own = b.column("text").filter(mine).to_pylist()
                    bag = held.setdefault(column, ([], []))
                    bag[0].extend(own)
                    bag[1].extend(b.column("weight").filter(mine).to_pylist())
                    chars += sum(map(len, own))
                if chars > FLUSH_CHARS:
                    yield from flush()
                    chars = 0
            yield from flush()

        return self.texts.select("col", "text", "weight").mapInArrow(count, "h bigint, e bigint, n bigint").groupBy("h").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))

    def _scores(self, counts: DataFrame) -> DataFrame:
        """Log-odds of "end" per distinct ending, from interpolated orders without the own text."""
        looked = self.tails.mapInArrow(_lookups, "col string, lang string, tail string, inside boolean, marked boolean, alike bigint, texts bigint, k int, h bigint").join(counts, "h", "left")
        wide = looked.groupBy(*IDS, "texts").agg(*(F.sum(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in ORDERS for c in "en"))
        p = F.lit(0.02)
        for k in ORDERS:
            e, n = (F.greatest(F.coalesce(F.col(f"{c}{k}"), F.lit(0)) - F.col("alike"), F.lit(0)) for c in "en")
            p = (e + p * SMOOTHING) / (n + F.lit(SMOOTHING))
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return wide.select(*IDS, "texts", F.log(p / (1 - p)).alias("odds"))

    def _fitted(self) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
        """Thresholds per (language, column), and what a mark adds per column."""
        cells = self.scored.groupBy("lang", "col", "marked", F.round("odds", 1).alias("at")).agg(F.sum("texts").alias("n")).collect()  # languages x columns x 600 at most
        by: dict[tuple[str, str], list[tuple[float, float]]] = {}
        for r in cells:
            if not r["marked"]:
                by.setdefault((r["lang"], r["col"]), []).append((r["at"], math.sqrt(r["n"])))
        thresholds = {k: valley(v) for k, v in by.items()}
        columns = {r["col"] for r in cells}
        return thresholds, {c: mark_evidence([(r["marked"], r["at"] - thresholds.get((r["lang"], c), DEFAULT_THRESHOLD), r["n"]) for r in cells if r["col"] == c]) for c in columns}

    def cut_endings(self) -> DataFrame:
        """The endings, ``IDS``, that are cut."""
        limit, mark = F.lit(DEFAULT_THRESHOLD), F.lit(0.0)
        for (lang, column), at in self.thresholds.items():
            limit = F.when((F.col("lang") == lang) & (F.col("col") == column), F.lit(at)).otherwise(limit)
        for column, x in self.marks.items():
            mark = F.when(F.col("marked") & (F.col("col") == column), F.lit(x)).otherwise(mark)
        return self.scored.filter(F.col("odds") + mark < limit).select(*IDS)

    def cut_texts(self) -> DataFrame:
        """(col, hash, size) of the distinct texts that are cut."""
        return self.endings.join(self.cut_endings().hint("shuffle_hash"), IDS, "left_semi").select("col", "hash", "size")

    def cut_rows(self) -> DataFrame:
        """(record_kind, record_key) of every row with a cut text."""
        return self.rows.join(self.cut_texts().hint("shuffle_hash"), ["col", "hash", "size"], "left_semi").select("record_kind", "record_key").distinct()

    def rates(self) -> DataFrame:
        """Rows, cut rows and their share per origin (source of instructions, run of predictions)."""
        cut = self.cut_texts().withColumn("cut", F.lit(1)).hint("shuffle_hash")
        rows = self.rows.join(cut, ["col", "hash", "size"], "left").groupBy("record_kind", "origin", "record_key").agg(F.max(F.coalesce("cut", F.lit(0))).alias("cut"))
        return rows.groupBy("record_kind", "origin").agg(F.count("*").alias("records"), F.sum("cut").alias("cut"), F.avg("cut").alias("rate"))


def message_texts(instructions: DataFrame, predictions: DataFrame) -> DataFrame:
    """The user's and the assistant's texts of instructions, and the texts of predictions, with the instruction they belong to."""
    record = canonical_id("instruction_id").alias("record")
    if "instruction_id" not in instructions.columns or "instruction_id" not in predictions.columns:
        record = F.lit(None).cast("string").alias("record")
    messages = instructions.select(F.col("delivery_id").alias("record_key"), record, canonical_token("metadata.source").alias("origin"), F.explode("messages").alias("m"))
    parts = messages.select("record_key", "record", "origin", canonical_token("m.role").alias("col"), F.explode("m.content.text").alias("text")).filter("col IN ('user', 'assistant')")
    said = parts.select(F.lit("instruction").alias("record_kind"), "record_key", "origin", "col", "text", "record")
    answers = predictions.select(F.lit("prediction").alias("record_kind"), F.col("prediction_no").alias("record_key"), F.col("run_id").alias("origin"), F.lit("prediction").alias("col"), F.col("prediction").alias("text"), record)
    return said.unionByName(answers)
