"""Scores for abusive, hateful or sexually explicit wording.

Two interpolated Kneser-Ney trigram models over normalised words, one of toxic and one of ordinary segments. Both back off
to their own continuation counts and at last to continuation counts shared by both, so a rare expression is judged by what
surrounds it rather than by a chance count. A segment's score is its log-likelihood under the toxic model less that under the
ordinary one, per word; a document's score is that of its worst segment, as a single insult in a long report must not
be averaged away.

Labels are given per document, so the toxic segments of toxic documents are found by repeated cross-fitting: documents are cut into folds, models
of the other folds score a fold's segments, and what scores above 0 is the toxic class of the next round. The threshold is the one with the
best F1 on scores from such held-out models (the middle of all that come close). The models are fitted on at most ``MAX_TRAIN`` labelled documents (all, or those with the smallest hashes), of a very
long one on ``MAX_SEGMENTS`` segments;
every document is scored, whole.

Words are normalised against disguise: entities, tags, repaired double encoding, compatibility forms, look-alike letters, accents, spaced or dotted
letters, digits and signs for letters, repeated letters; masked words (``f**k``) become one word.

Defined results: null, blank and wordless texts score ``EMPTY_SCORE`` and are never toxic; raters vote, null labels don't count and ties leave a document out
of training; without both classes nothing is toxic; repeated rows get equal scores.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.hashing import uniform
from sightline.functions.text import canonical_token
from sightline.storage import cut_lineage

MAX_TRAIN = 20_000
#: Distinct segments of one labelled document that models are fitted on.
MAX_SEGMENTS = 2_000
FOLDS = 3
ROUNDS = 2
DISCOUNT = 0.75
NEAR = 0.997
#: Log-odds per word beyond which a held-out segment is taken for toxic, or below its negative for ordinary; between, it trains neither.
SURE = 0.5
#: Weight of the shared counts in either class's last backoff. It is the same for both, so that a word that no
#: labelled text holds says nothing, however much smaller one class is.
SHARED = 0.4
WINDOW = 20
EMPTY_SCORE = -99.0
CACHE = 200_000

#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKE = str.maketrans("аеорсухіѕјԁһвкмнтοαερικντυχ", "aeopcyxisjdhbkmhtoaepikvtux")
SIGNS = str.maketrans("013457@$!|", "oieastasii")

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_DOUBLE = re.compile("[ÂÃ][\u0080-¿]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_DOTTED = re.compile(r"(?<!\w)\w(?:[.\-_·]\w){2,}(?!\w)")
_SPACED = re.compile(r"(?<!\w)\w(?: \w){3,}(?!\w)")
_SEGMENT = re.compile(r"(?<=[.!?…])\s+|[\n\r]+|\s{0,3}\|\s|(?<=[.!?])(?=<)")
_WORD = re.compile(r"(?:[@$](?=[^\W\d_]))?[^\W_](?:[^\W_]|[*@$!|](?=[^\W_*@$!|]|[*@$]+[^\W_])|[@$]+(?![\w*@$])|['’\-](?=[^\W_]))*")
#: Numbers, times and codes such as A-1234b; digits within a word are none.
_NUMBER = re.compile(r"(?<![^\W_])(?:[A-Za-z]-)?\d[\d.,:%]*[a-h]?(?![^\W_])")
_REPEAT = re.compile(r"(.)\1{2,}")
_SIGNED = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|^[@$]+(?=[a-z])|(?<=[a-z])[@$]+$")
#: Digits at the edges of a word, read as letters where a sign or digit within it shows a disguise, or where they begin a word of three letters and more.
_EDGES = re.compile(r"^[013457@$!|]+(?=[a-z])|(?<=[a-z])[013457@$!|]+$")
_BEGUN = re.compile(r"^[01345]{1,2}(?=[a-z]{3})")
MASKED = "<masked>"


def unwrapped(text: str) -> str:
    """Without entities and tags, and with double encoding repaired."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" \n", text)
    if "Ã" in text or "Â" in text:
        text = _DOUBLE.sub(lambda m: m.group(0).encode("latin-1").decode("utf-8", "ignore"), text)
    return text


def folded(text: str) -> str:
    """Lower case, look-alikes and accents as plain letters, spaced and dotted letters joined."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(LOOK_ALIKE)
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = _DOTTED.sub(lambda m: re.sub(r"[.\-_·]", "", m.group(0)), text.lower())
    return _SPACED.sub(lambda m: m.group(0).replace(" ", ""), text)


def cleaned(text: str) -> str:
    return folded(unwrapped(text))


def words(segment: str) -> tuple[str, ...]:
    out = []
    for w in _WORD.findall(segment):
        if w.isalpha():
            pass
        elif "*" in w:
            w = MASKED
        else:
            if not w.isascii() or any(c in "013457@$!|" for c in w):
                plain = lambda m: m.group(0).translate(SIGNS)
                clear = _SIGNED.sub(plain, w)
                w = _EDGES.sub(plain, clear) if clear != w else _BEGUN.sub(plain, clear)
            if any(c.isdigit() for c in w):
                continue
        out.append(_REPEAT.sub(r"\1", w) if len(w) > 3 else w)
    return tuple(out)


def sentences(text: str) -> list[str]:
    """Sentences and lines, with numbers and codes, which are no words, as #: sentences that differ in them alone become equal."""
    return _SEGMENT.split(_NUMBER.sub("#", unwrapped(text)))


def windows(sentence: str) -> list[tuple[str, ...]]:
    """The normalised words of a sentence; overlapping windows of a long one."""
    w = words(folded(sentence))
    if len(w) <= WINDOW:
        return [w] if w else []
    return [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]


def segments(text: str) -> Iterator[tuple[str, ...]]:
    """Normalised segments of a text."""
    for sentence in sentences(text):
        yield from windows(sentence)


UNKNOWN, START, END = 0, 1, 2


def _positions(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the segments, and of their ends: the two words before it, itself, and its segment's number."""
    sizes = np.array([len(r) + 3 for r in rows], dtype=np.int64)
    flat = np.fromiter((w for r in rows for w in (START, START, *r, END)), dtype=np.int64, count=int(sizes.sum()))
    number = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= 2)
    return flat[at - 2], flat[at - 1], flat[at], number[at]


class Counts:
    """Counts of one class over the trigrams, pairs and contexts of a ``Table``."""

    def __init__(self, table: Table, weights: np.ndarray) -> None:
        self.tri = np.bincount(table.tri_of, weights[table.segment_of], len(table.tri_keys))
        used = self.tri > 0
        self.bi = np.bincount(table.bi_of_tri[used], minlength=len(table.bi_keys)).astype(float)
        pairs = self.bi > 0
        self.uni = np.bincount(table.last_of_bi[pairs], minlength=table.size).astype(float)
        self.tri_total = np.bincount(table.context_of_tri, self.tri, len(table.context_keys))
        self.tri_kinds = np.bincount(table.context_of_tri[used], minlength=len(table.context_keys)).astype(float)
        self.bi_total = np.bincount(table.first_of_bi, self.bi, table.size)
        self.bi_kinds = np.bincount(table.first_of_bi[pairs], minlength=table.size).astype(float)

    def unigrams(self, shared: np.ndarray) -> np.ndarray:
        pairs = self.uni.sum()
        return (1 - SHARED) * self.uni / pairs + SHARED * shared if pairs else shared


def _interpolated(p: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """One order of Kneser-Ney over the next lower one; that one where the context is unknown."""
    return np.where(total > 0, (np.maximum(count - DISCOUNT, 0.0) + DISCOUNT * kinds * p) / np.maximum(total, 1e-300), p)


class Table:
    """Distinct segments as numbers: which trigrams they hold, and each trigram's parts."""

    def __init__(self, segments_: list[tuple[str, ...]]) -> None:
        self.vocabulary: dict[str, int] = {"": UNKNOWN, "<s>": START, "</s>": END}
        rows = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in segments_]
        self.size = n = len(self.vocabulary)
        u, v, x, self.segment_of = _positions(rows)
        self.lengths = np.array([len(r) + 1 for r in rows], dtype=float)
        self.tri_keys, self.tri_of = np.unique((u * n + v) * n + x, return_inverse=True)
        self.bi_keys, self.bi_of_tri = np.unique(self.tri_keys % (n * n), return_inverse=True)
        self.context_keys, self.context_of_tri = np.unique(self.tri_keys // n, return_inverse=True)
        self.first_of_bi, self.last_of_bi = self.bi_keys // n, self.bi_keys % n

    def trained(self, toxic: np.ndarray, ordinary: np.ndarray) -> Models | None:
        """The models of both classes from the weights of segments; None without both."""
        return Models(self, Counts(self, toxic), Counts(self, ordinary)) if toxic.any() and ordinary.any() else None

    def scores(self, models: Models) -> np.ndarray:
        """Log-odds per word of every segment of the table."""
        odds = models.odds(np.arange(len(self.tri_keys)), self.bi_of_tri, self.context_of_tri, self.first_of_bi[self.bi_of_tri], self.last_of_bi[self.bi_of_tri])
        return np.bincount(self.segment_of, odds[self.tri_of], len(self.lengths)) / self.lengths


class Models:
    """Interpolated trigram models of the toxic and the ordinary class; the last backoff is shared by both."""

    def __init__(self, table: Table, toxic: Counts, ordinary: Counts) -> None:
        before = np.bincount(table.last_of_bi[(toxic.bi > 0) | (ordinary.bi > 0)], minlength=table.size).astype(float)
        total, kinds = before.sum() + 1.0, int((before > 0).sum())
        rest = (DISCOUNT * kinds + 1.0) / total / (kinds + 1 + 10_000)
        shared = np.where(before > 0, (before - DISCOUNT) / total, rest)
        self.vocabulary, self.size, self.classes = table.vocabulary, table.size, [toxic, ordinary]
        self.words = [c.unigrams(shared) for c in self.classes]
        self.keys = [table.tri_keys, table.bi_keys, table.context_keys]

    def odds(self, tri: np.ndarray, bi: np.ndarray, context: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Log-odds of each position; a number of -1 stands for a trigram, pair or context that isn't known."""
        logs = []
        for c, words_ in zip(self.classes, self.words):
            known = lambda values, at: np.where(at >= 0, values[at], 0.0)
            p = _interpolated(words_[x], known(c.bi, bi), c.bi_total[v], c.bi_kinds[v])
            logs.append(np.log(_interpolated(p, known(c.tri, tri), known(c.tri_total, context), known(c.tri_kinds, context))))
        return logs[0] - logs[1]

    def score(self, segments_: list[tuple[str, ...]]) -> np.ndarray:
        """Log-odds per word of segments."""
        if not segments_:
            return np.zeros(0)
        get = self.vocabulary.get
        u, v, x, number = _positions([[get(w, UNKNOWN) for w in s] for s in segments_])
        n = self.size
        found = []
        for keys, wanted in zip(self.keys, ((u * n + v) * n + x, v * n + x, u * n + v)):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found.append(np.where(keys[at] == wanted, at, -1))
        odds = self.odds(*found, v, x)
        return np.bincount(number, odds, len(segments_)) / np.array([len(s) + 1 for s in segments_])


def _best_threshold(scored: list[tuple[float, bool]]) -> tuple[float, dict[str, float]]:
    """The score that parts toxic from ordinary documents: the middle of all whose F1 is within ``NEAR`` of the best."""
    hits, total, all_f1 = 0, sum(t for _, t in scored), []
    ranked = sorted(scored, reverse=True)
    for i, (x, toxic) in enumerate(ranked, 1):
        hits += toxic
        if i == len(ranked) or ranked[i][0] < x:
            at = (x + ranked[i][0]) / 2 if i < len(ranked) else x
            all_f1.append((2 * hits / (i + total), at, {"precision": hits / i, "recall": hits / total if total else 0.0}))
    if not total or not all_f1:
        return math.inf, {"f1": 0.0}
    best = max(f1 for f1, _, _ in all_f1)
    near = [at for f1, at, _ in all_f1 if f1 >= NEAR * best]
    middle = (min(near) + max(near)) / 2
    f1, _, quality = min(all_f1, key=lambda x: abs(x[1] - middle))
    return middle, {"f1": f1, **quality}


def fit(docs: list[tuple[int, bool, list[tuple[str, ...]]]]) -> tuple[Models | None, float, dict[str, float]]:
    """Models, threshold and held-out quality from (doc_id, toxic, distinct segments)."""
    docs = [d for d in docs if d[2]]
    if len({t for _, t, _ in docs}) < 2:
        return None, math.inf, {}
    number: dict[tuple[str, ...], int] = {}
    held = [np.array([number.setdefault(w, len(number)) for w in ws]) for _, _, ws in docs]
    table = Table(list(number))
    fold_of = np.array([zlib.crc32(str(i).encode()) % FOLDS for i, _, _ in docs])
    toxic_of = np.array([t for _, t, _ in docs])
    each, sizes = np.concatenate(held), np.array([len(h) for h in held])
    starts = np.cumsum(sizes) - sizes
    count = np.zeros((FOLDS, 2, len(number)))
    np.add.at(count, (np.repeat(fold_of, sizes), np.repeat(toxic_of.astype(int), sizes), each), 1)
    first = count[:, 1].sum(0) > count[:, 0].sum(0)  # more often in toxic documents, although these are few
    suspects, undecided = first, np.zeros(len(number), dtype=bool)

    def trained(leave: int | None) -> Models | None:
        kept = count[[f for f in range(FOLDS) if f != leave]]
        return table.trained(kept[:, 1].sum(0) * suspects, kept.sum((0, 1)) * ~(suspects | undecided))

    best, quality = 0.0, {}
    for turn in range(ROUNDS + 1):
        worst = np.empty(len(docs))
        values = np.full(len(number), EMPTY_SCORE)
        for fold in range(FOLDS):
            models = trained(fold)
            scores = table.scores(models) if models else np.full(len(number), EMPTY_SCORE)
            own = fold_of == fold
            worst[own] = np.maximum.reduceat(scores[each], starts)[own]
            here = first & (count[fold].sum(0) > 0)
            values[here] = np.maximum(values[here], scores[here])
        best, quality = _best_threshold(list(zip(worst.tolist(), toxic_of.tolist())))
        kept = first & (values > max(SURE, best / 2))
        if turn < ROUNDS and kept.any():
            suspects, undecided = kept, first & ~kept & (values > -SURE)
    return trained(None), best, quality


def _bounded(text: str | None) -> list[str]:
    """The distinct segments of a labelled text, words joined by blanks; of very many those with the smallest hashes."""
    found = list(dict.fromkeys(" ".join(w) for w in segments(text or "")))
    return found if len(found) <= MAX_SEGMENTS else sorted(found, key=lambda x: (zlib.crc32(x.encode()), x))[:MAX_SEGMENTS]


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents, by a majority of raters."""
    label = canonical_token("label")
    votes = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(label == "clean").alias("good"), F.count_if(label.isin("abusive", "hateful", "sexual")).alias("bad"))
    decided = votes.filter("good <> bad").select("doc_id", (F.col("bad") > F.col("good")).alias("toxic"))
    chosen = decided.orderBy(uniform(F.lit(7), "doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))


class ToxicityModel:
    def __init__(self, documents: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> None:
        self.spark = documents.sparkSession

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([_bounded(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["doc_id", "toxic", "segments"])

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs = [(r["doc_id"], r["toxic"], [tuple(x.split(" ")) for x in r["segments"]]) for b in batches for r in b.to_pylist()]
            models, threshold, quality = fit(sorted(docs, key=lambda x: x[0]))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(models), 1)], pa.binary()), pa.array([threshold]), pa.array([list(quality.items())], pa.map_(pa.string(), pa.float64()))], names=["model", "threshold", "quality"])

        sample = labelled(documents, labels, most).mapInArrow(cut, "doc_id bigint, toxic boolean, segments array<string>")
        row = sample.repartition(1).mapInArrow(train, "model binary, threshold double, quality map<string,double>").first()  # bounded by MAX_TRAIN and MAX_SEGMENTS
        self.threshold, self.quality = (row["threshold"], row["quality"]) if row else (math.inf, {})
        self.model = self.spark.sparkContext.broadcast(bytes(row["model"]) if row else zlib.compress(pickle.dumps(None)))  # bounded by the sample

    def scores(self, documents: DataFrame) -> DataFrame:
        """(doc_id, source, score, toxic) of every document."""
        shared, threshold = self.model, self.threshold

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = pickle.loads(zlib.decompress(shared.value))
            known: dict[str, float] = {}

            for b in batches:
                coded = b.column("text").dictionary_encode()
                texts = [sentences(t) if models and t else [] for t in coded.dictionary.to_pylist()]
                if len(known) >= CACHE:
                    known.clear()
                fresh = list(dict.fromkeys(x for t in texts for x in t if x not in known))
                cut = [windows(x) for x in fresh]
                values = iter(models.score([w for ws in cut for w in ws]).tolist() if models else [])
                for x, ws in zip(fresh, cut):
                    known[x] = max((next(values) for _ in ws), default=EMPTY_SCORE)
                worst = pa.array([max((known[x] for x in t), default=EMPTY_SCORE) for t in texts], pa.float64()).take(coded.indices).fill_null(EMPTY_SCORE)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), worst], names=["doc_id", "source", "score"])

        scored = documents.select("doc_id", canonical_token("source").alias("source"), "text").mapInArrow(score, "doc_id bigint, source string, score double")
        return cut_lineage(scored.withColumn("toxic", F.col("score") > F.lit(threshold)), "p7-scores")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, toxic ones and their share per source."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("toxic").alias("toxic"), F.avg(F.col("toxic").cast("double")).alias("rate"))
