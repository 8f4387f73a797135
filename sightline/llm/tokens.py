"""Sizes of texts in tokens of a public tokenizer; the vocabulary stays where it is and is never trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = os.environ.get("SIGHTLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the byte-level vocabulary cuts texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer at ``path``, loaded once per worker process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and ``tokens``, the size of the whole text; a null or empty text has 0. Equal texts of a batch are encoded once."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        for b in batches:
            coded = b.column("__text").dictionary_encode()
            sizes = pa.array([len(tokenizer.encode_ordinary(t)) if t else 0 for t in coded.dictionary.to_pylist()], pa.int64())
            counted = sizes.take(coded.indices).fill_null(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), counted], names=[*keep, "tokens"])

    chosen = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "__text")
    return chosen.mapInArrow(size, f"{fields}, tokens bigint")
