"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by a pattern; each is merged separately.  A pre-token that is
itself a token is that token.  Otherwise a segment tree over its byte positions holds, at
each live position, the rank of the pair that begins there, and in each inner node the
leftmost minimum below.  The root names the next merge; the merge takes the right
neighbour out and recomputes the pairs of the two live neighbours: three point updates of
logarithmic cost, so a pre-token of n bytes takes O(n log n), however long it is.

Results are cached in each Python worker in two generations of a bounded number of
pre-tokens: a full one becomes the old one, and what is still used comes back from it.  Documents are encoded where they are
read: no shuffle, and memory is that of one batch of texts.

Defined results: null and empty texts encode to no ids, no ids decode to no bytes; rows
are independent, so repeated rows repeat their results.  The input's other columns are
not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import steps, worker_state

CACHED = 350_000
#: Documents whose ids are held at a time in a task.
STEP = 256
#: Longer pre-tokens are encoded each time they occur.
CACHED_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64-token rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * size + size  # above rank * size + position of every pair
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = list(range(1, n + 1))  # of a live position: where the next part begins
    before = list(range(-1, n - 1))

    get = ranks.get
    while (low := tree[1]) < none:
        i = low % size
        j = after[i]  # joined to i, no longer live
        k = after[i] = after[j]
        here = before_here = none
        if k < n:
            before[k] = i
            r = get(piece[i:after[k]])
            if r is not None:
                here = r * size + i
        p = before[i]
        if p >= 0:
            r = get(piece[p:k])
            if r is not None:
                before_here = r * size + p
        for node, value in ((size + j, none), (size + i, here), (size + p, before_here))[:2 + (p >= 0)]:
            while node >= 1 and tree[node] != value:  # up until a node doesn't change
                tree[node] = value
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class _Encoder(dict):
    """Pre-token -> its ids as the bytes of 32-bit integers; what isn't held is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Tokenizer:
    """Bytes of each id of a rank file, and the cache of encoded pre-tokens."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.bytes[r] = token
        self.encoder = _Encoder(ranks)


def _worker(path: str) -> _Tokenizer:
    return worker_state(("bpe", path), lambda: _Tokenizer(path))


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    import regex

    return np.frombuffer(b"".join(map(_worker(path).encoder.__getitem__, regex.findall(pattern, text))), np.intc)


def decode_ids(ids: list[int], path: str) -> bytes:
    """The bytes of a list of ids; unknown ids raise."""
    return b"".join(map(_worker(path).bytes.__getitem__, ids))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document.  ``path``: a rank file on every worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, STEP):
            ids = [encode_text(t.as_py() or "", path, pattern) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the binary column ``out``."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, STEP):
            texts = [decode_ids(x.values.to_numpy().tolist(), path) if x.is_valid else None for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*names, out])

    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])
    return encoded.mapInArrow(run, schema)
