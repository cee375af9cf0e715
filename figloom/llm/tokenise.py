"""Encoding of texts with a public byte-level BPE vocabulary.

Each piece of a text is merged by a segment tree over the ranks of adjacent pairs: the root yields the leftmost pair
of lowest rank, a merge updates three leaves and their paths, and it ends when no pair in the tree can be merged. So
a piece of n bytes takes O(n log n), also where a text is one piece of many megabytes. Short pieces recur; each Python
worker keeps their ids in a table of bounded size.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how this family of vocabularies cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
CACHED_BYTES = 64
CACHE_ENTRIES = 400_000


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        parts[i] = parts[i] + parts[j]  # type: ignore[operator]
        parts[j] = None
        after[i] = k = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            r = rank(parts[i] + parts[k])  # type: ignore[operator]
            put(i, NONE if r is None else r << 32 | i)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            r = rank(parts[h] + parts[i])  # type: ignore[operator]
            put(h, NONE if r is None else r << 32 | h)
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Texts to ids, without special tokens: their strings in a text are ordinary text."""

    def __init__(self, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> None:
        self.ranks = load_ranks(path)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        """Ids of one text; none for an empty or null one."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= CACHED_BYTES:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode(documents: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{VOCABULARY}", keep: tuple[str, ...] = (), counts_only: bool = False) -> DataFrame:
    """(id, *keep, ids) or, with ``counts_only``, (id, *keep, n_tokens) of every row; a null text has no tokens.

    ``path`` is a vocabulary file on the driver, sent to every executor once. No row is exchanged between tasks.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    rows = documents.select(id_col, *keep, text)
    kinds = [rows.schema[c] for c in (id_col, *keep)]
    last = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    names = [f.name for f in kinds] + [last.name]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds] + [(last.name, pa.int64() if counts_only else pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(name))
        for b in batches:
            coded = [encoder(t) for t in b.column(len(kinds)).to_pylist()]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            if counts_only:
                result = pa.array(sizes)
            else:
                flat = np.fromiter((i for ids in coded for i in ids), np.int32, int(sizes.sum()))
                result = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            cols = [b.column(i) for i in range(len(kinds))] + [result]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow)], names=names)

    return rows.mapInArrow(run, T.StructType([*kinds, last]))
