"""Periodic run detection by block convolution.

A *run* is a stretch of words with smallest period q (words q apart are equal) and at least
``max(24, 3 q)`` words that can't be made longer on either side with period q.

**Block convolution at dyadic scales.**  At scale L = 8, 16, 32, ... the text is cut into
blocks of L words.  A run with L <= q < 2 L has 3 q > 2 L - 1 + q words, so one of the
blocks lies in it together with its copy q words on; with q < 8 the 24 words do the same
for L = 8.  So each block is compared with the window that follows: the sum of squared
differences between the block and every place of the window is

    sum b^2 + sum w^2 - 2 sum b w

whose last term for all places is one convolution, computed exactly by a number theoretic
transform modulo ``P``.  Words are numbered densely over a batch and mapped to values below
P, so a copy of the block always gives zero.  A zero that isn't a copy (sums that are
multiples of P) falls at the next step.

**Distances seed extensions.**  A place with zero mismatches at distance d starts an
extension to both sides while words d apart are equal.  Distances are taken in ascending
order, so the smallest period of a stretch is found first, and seeds inside a run whose
period divides d are skipped.

Blocks of all documents of a batch are transformed together.  A block with a word that does
not come again within the window can't have a copy there and isn't transformed.  A task
holds one slice of documents; a document is one row and is worked on whole.

Defined results: null and empty texts have no runs; repeated rows get equal results; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import worker_state

SHORTEST = 24
TIMES = 3
FIRST_SCALE = 8
#: Prime 15 * 2^27 + 1 with primitive root 31: transforms of up to 2^27 values.
P = 2013265921
ROOT = 31
#: Words that a task transforms at a time, and characters of a slice of documents.
CHUNK = 1 << 18
SLICE = 4 << 20

Run = tuple[int, int, int]  # start, length, period


class Transforms:
    """Roots of unity by transform size."""

    def __init__(self):
        self.roots: dict[int, tuple[list[np.ndarray], list[np.ndarray], int]] = {}

    def of(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        if n not in self.roots:
            ahead, back = [], []
            w, half = pow(ROOT, (P - 1) // n, P), n // 2
            while half:
                powers = np.ones(half, np.uint64)
                for i in range(1, half) if half < 64 else ():
                    powers[i] = int(powers[i - 1]) * w % P
                if half >= 64:  # double the known powers
                    k = 1
                    while k < half:
                        powers[k:2 * k] = powers[:k] * np.uint64(pow(w, k, P)) % np.uint64(P)
                        k *= 2
                ahead.append(powers)
                inverse = powers.copy()
                inverse[1:] = np.uint64(P) - powers[:0:-1]
                back.append(inverse)
                w, half = w * w % P, half // 2
            self.roots[n] = ahead, back, pow(n, P - 2, P)
        return self.roots[n]

    def forward(self, a: np.ndarray) -> np.ndarray:
        """Transform of the rows of ``a`` (values below P), in bit-reversed order."""
        rows, n = a.shape
        p, size = np.uint64(P), n
        for powers in self.of(n)[0]:
            v = a.reshape(rows, n // size, 2, size // 2)
            lo, hi = v[:, :, 0], v[:, :, 1]
            out = np.empty_like(v)
            s = lo + hi
            out[:, :, 0] = np.where(s >= p, s - p, s)
            out[:, :, 1] = (lo + (p - hi)) * powers % p
            a, size = out.reshape(rows, n), size // 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        """Inverse of :meth:`forward`."""
        rows, n = a.shape
        p, size = np.uint64(P), 2
        _, back, scale = self.of(n)
        for powers in reversed(back):
            v = a.reshape(rows, n // size, 2, size // 2)
            lo, hi = v[:, :, 0], v[:, :, 1] * powers % p
            out = np.empty_like(v)
            s = lo + hi
            out[:, :, 0] = np.where(s >= p, s - p, s)
            d = lo + (p - hi)
            out[:, :, 1] = np.where(d >= p, d - p, d)
            a, size = out.reshape(rows, n), size * 2
        return a * np.uint64(scale) % p


def _mismatches(t: Transforms, blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences (mod P) of blocks (rows x L) with all L + 1 places of
    their windows (rows x 2 L)."""
    rows, size = blocks.shape
    p = np.uint64(P)
    turned = np.zeros_like(windows)  # index -j mod 2 L: the product is a correlation
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1:] = blocks[:, :0:-1]
    product = t.backward(t.forward(turned) * t.forward(windows) % p)[:, :size + 1]
    squares = np.zeros((rows, 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % p).sum(axis=1) % p
    there = (squares[:, size:] - squares[:, :size + 1]) % p
    return (own[:, None] + there + np.uint64(2) * (p - product)) % p


def seeds(t: Transforms, values: np.ndarray, again: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """(document, block start, distance, block size) of zero-mismatch places.  ``values``
    are the words of all documents, ``again`` the distance to each word's next occurrence,
    ``start`` and ``end`` the documents' bounds."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    size, n_words = FIRST_SCALE, end - start
    far = np.concatenate([again, [1 << 60]])
    padded = np.concatenate([values, np.zeros(1, np.uint64)])
    while True:
        lowest = 1 if size == FIRST_SCALE else size
        need = max(SHORTEST, TIMES * lowest)
        docs = np.flatnonzero(n_words >= need)
        if not len(docs):
            break
        per = n_words[docs] // size
        doc = np.repeat(docs, per)
        at = start[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
        # a copy within the window needs every word again within 2 L words
        marks = np.concatenate([[0], np.cumsum(far[:-1] >= 2 * size)])
        hit = marks[at + size] == marks[at]
        doc, at = doc[hit], at[hit]
        step = max(1, CHUNK // size)
        for i in range(0, len(at), step):
            a, d = at[i:i + step], doc[i:i + step]
            index = a[:, None] + np.arange(size)
            for shift in ((1, size) if size == FIRST_SCALE else (size,)):
                w = a[:, None] + shift + np.arange(2 * size)
                outside = w >= end[d][:, None]
                window = padded[np.where(outside, len(values), w)]
                row, place = np.nonzero(_mismatches(t, padded[index], window) == 0)
                distance = place + shift
                ok = (distance < 2 * size) & (distance >= (lowest if shift == size else 1)) & (a[row] + distance + size <= end[d[row]])
                if shift == 1:
                    ok &= distance < size
                for out, x in zip(found, (d[row[ok]], a[row[ok]], distance[ok], np.full(ok.sum(), size)), strict=True):
                    out.append(x)
        size *= 2
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in found]


def _stretch(w: np.ndarray, b: int, size: int, d: int) -> tuple[int, int]:
    """Longest stretch around the block with words ``d`` apart equal; empty if the block
    isn't equal to its copy."""
    if (w[b:b + size] != w[b + d:b + d + size]).any():
        return b, b
    lo, hi, step = b, b + size, 64
    while lo:
        k = max(0, lo - step)
        bad = np.flatnonzero(w[k:lo] != w[k + d:lo + d])
        if len(bad):
            lo = k + int(bad[-1]) + 1
            break
        lo, step = k, step * 2
    step = 64
    while hi + d < len(w):
        k = min(len(w) - d, hi + step)
        bad = np.flatnonzero(w[hi:k] != w[hi + d:k + d])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = k, step * 2
    return lo, hi + d


def runs_of(w: np.ndarray, blocks: np.ndarray, distances: np.ndarray, sizes: np.ndarray) -> list[Run]:
    """Runs of one document from its seeds (block starts counted within the document)."""
    found: list[Run] = []
    known: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts, ends of its runs
    last, reach = 0, -1
    order = np.lexsort((blocks, distances))
    for b, d, size in zip(blocks[order].tolist(), distances[order].tolist(), sizes[order].tolist(), strict=True):
        if d != last:
            last, reach = d, -1
        if b + size + d <= reach:  # in the stretch that was just extended
            continue
        inside = False
        for q, (starts, ends) in known.items():
            if d % q == 0:
                i = bisect_right(starts, b) - 1
                if i >= 0 and ends[i] >= b + size + d:
                    inside = True
                    break
        if inside:
            continue
        lo, hi = _stretch(w, b, size, d)
        reach = hi
        if hi - lo >= max(SHORTEST, TIMES * d):
            found.append((lo, hi - lo, d))
            starts, ends = known.setdefault(d, ([], []))
            i = bisect_right(starts, lo)
            starts.insert(i, lo)
            ends.insert(i, hi)
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(texts: list[list[bytes]], t: Transforms) -> list[list[Run]]:
    """Runs of every document, given as words."""
    n = np.array([len(x) for x in texts], np.int64)
    end = np.cumsum(n)
    start = end - n
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for x in texts for w in x), np.int64, int(n.sum()))
    # next occurrence within the document
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((np.arange(len(codes)), codes, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    again = np.full(len(codes), 1 << 60, np.int64)
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    values = (codes.astype(np.uint64) % np.uint64(P - 1)) + np.uint64(1)  # 0 stands for no word
    which, at, distance, size = seeds(t, values, again, start, end)
    out: list[list[Run]] = [[] for _ in texts]
    order = np.argsort(which, kind="stable")
    which, at, distance, size = (x[order] for x in (which, at, distance, size))
    cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]])) if len(which) else []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        k = int(which[i])
        s = int(start[k])
        out[k] = runs_of(codes[s:int(end[k])], at[i:j] - s, distance[i:j], size[i:j])
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        mark[s + q] += 1
        mark[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``__runs``, an array of
    (start, length, period) by start, then period, and ``__collapsed``, the words that stay
    joined by one space."""
    carry = [c for c in docs.columns if c not in ("__runs", "__collapsed")] if carry is None else carry
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(("transforms",), Transforms)
        for b in batches:
            text = b.column(b.num_columns - 1)
            size = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in text), np.int64, b.num_rows)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0)).tolist()
            bounds = [0, *[i for i in cut if i], b.num_rows]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in text.slice(i, j - i)]
                found = find_runs(words, t)
                kept = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)], pa.binary())
                spans = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), spans, kept.cast(pa.string())],
                                                 names=[*carry, "__runs", "__collapsed"])

    runs = T.ArrayType(T.StructType.fromDDL("start long, length long, period long"))
    schema = T.StructType([docs.schema[c] for c in carry]).add("__runs", runs).add("__collapsed", "string")
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("binary").alias("__t")).mapInArrow(run, schema)
