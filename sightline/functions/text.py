"""String normalisation as Column expressions; no UDF is involved.

Python's ``strip`` and ``\\s`` treat every Unicode blank as a blank, so the patterns carry ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
_built: dict[tuple, tuple] = {}


def built_once(f: Callable) -> Callable:
    """Keeps what a function without side effects builds of Columns, which never change, as each part of a large expression costs a call into the JVM."""

    @wraps(f)
    def build(*args):
        key, gateway = (f.__module__, f.__qualname__, args), SparkContext._gateway
        if key not in _built or _built[key][0] is not gateway:
            _built[key] = (gateway, f(*args))
        return _built[key][1]

    return build


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Without Unicode blanks at either end. Text between two visible ASCII characters, the usual case, is passed on as it is."""
    t = col(c)
    ends = [F.substring(t, 1, 1).between("!", "~"), F.substring(t, -1, 1).between("!", "~")]
    return F.when(ends[0] & ends[1], t).otherwise(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))


def canonical_token(c: ColumnOrName) -> Column:
    """Lower case, no outer blanks, and ``_`` for every run of inner blanks or hyphens; an empty token is null.

    Tokens spelled canonically, nearly all, are passed on after one plain match.
    """
    t = col(c)
    spelled = F.nullif(F.regexp_replace(F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_"), F.lit(""))
    return F.when(t.rlike("^[a-z0-9_]+$"), t).otherwise(spelled)


def canonical_id(c: ColumnOrName) -> Column:
    """Lower case without outer blanks; an empty identifier is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


#: The usual words for the three splits.
SPLIT_WORDS = {
    "train": ["train", "training", "trn", "tr"],
    "validation": ["validation", "valid", "val", "dev", "development"],
    "test": ["test", "testing", "tst"],
}


def canonical_split(c: ColumnOrName) -> Column:
    """train, validation or test; null for any other word."""
    token, out = canonical_token(c), F.lit(None).cast("string")
    for name, words in SPLIT_WORDS.items():
        out = F.when(token.isin(words), F.lit(name)).otherwise(out)
    return out


def norm_name(c: ColumnOrName) -> Column:
    """Runs of anything but a-z and 0-9 become ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def norm_token(c: ColumnOrName) -> Column:
    """Lower case, with ``_`` for each space or hyphen."""
    return F.translate(F.lower(col(c)), " -", "__")


def norm_label(c: ColumnOrName) -> Column:
    """norm_name with ``&`` read as "and"; null becomes the empty string."""
    return norm_name(F.replace(F.coalesce(col(c), F.lit("")), F.lit("&"), F.lit(" and ")))


def squeeze(c: ColumnOrName) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def norm_text(c: ColumnOrName) -> Column:
    """Lower case and squeezed, punctuation kept; null becomes the empty string."""
    return F.coalesce(F.lower(squeeze(c)), F.lit(""))


def norm_meta(c: ColumnOrName) -> Column:
    """Comma-separated parts with ``_`` read as a space, squeezed and lower-cased, joined by ``, `` without blanks."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.lower(squeeze(F.replace(x, F.lit("_"), F.lit(" ")))))
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")


def norm_decoded(c: ColumnOrName, end_token: str = "<|im_end|>") -> Column:
    """Decoded model text without its end token, squeezed and lower-cased."""
    return F.lower(squeeze(F.replace(col(c), F.lit(end_token), F.lit(""))))


def split_compound(c: ColumnOrName) -> Column:
    """Sorted distinct normalised atoms of a comma-joined label; null gives an empty array."""
    atoms = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), norm_label)
    return F.array_sort(F.array_distinct(F.filter(atoms, lambda x: x != "")))


def contains_phrase(text: ColumnOrName, phrase: ColumnOrName) -> Column:
    """Whether the normalised text holds the normalised phrase as whole tokens."""
    t, p = norm_label(text), norm_label(phrase)
    return (p != "") & F.contains(F.concat(F.lit("_"), t, F.lit("_")), F.concat(F.lit("_"), p, F.lit("_")))


def humanize(c: ColumnOrName, missing: str = "not applicable") -> Column:
    """``_`` read as a space and commas followed by one; a phrase for null."""
    return F.coalesce(F.replace(F.replace(col(c), F.lit("_"), F.lit(" ")), F.lit(","), F.lit(", ")), F.lit(missing))


def word_count(c: ColumnOrName) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda x: x != "")).cast("bigint")
