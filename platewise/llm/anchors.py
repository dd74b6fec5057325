"""Anchors of windows: what the operators on repeated text share.

A text is a sequence of *letters* (64-bit values of bytes or of words), a *window* is
``length`` consecutive letters of one document.  Its *anchor* is the leftmost of its
``offsets`` grams with the least hash; the consecutive windows that choose one anchor are a
*run*.  Equal windows have equal anchors at equal places, so repeats are found among the
runs with equal grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_ORDER = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shape:
    """Window length, grams a window, and the size of the parts that a run is cut into."""

    def __init__(self, length: int, offsets: int, part: int):
        self.length, self.offsets, self.part = length, offsets, max(1, part)
        self.gram = length - offsets + 1


class Powers:
    """Powers of the multiplier and of its inverse, kept in a worker."""

    def __init__(self, least: int):
        self.n, self.least = -1, least     # none yet, also for documents without words

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n < n:
            n = max(n, self.least)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, m, np.uint64))])
                                  for m in (MULTIPLIER, _INVERSE))
            self.n = n
        return self.up, self.down


class Runs:
    """Window runs ``first``, ``count`` of documents that lie one after another in
    ``letters``, with their anchors ``at`` and the anchors' hashes ``h``."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape, powers: Powers):
        n, self.shape = len(letters), shape
        k, length = shape.offsets, shape.length
        if n < length:
            self.first = self.count = self.at = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        up, self.down = powers.upto(n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * up[:n])])
        grams = self.sums[shape.gram:] - self.sums[:-shape.gram]
        grams *= self.down[:n - shape.gram + 1]
        # leftmost least hash of each k grams: minima of prefixes and suffixes of tiles of k;
        # the high half of a product depends on all bits of the gram
        key = grams * np.uint64(_ORDER)
        key &= np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(grams), dtype=np.uint64)
        tiles = np.concatenate([key, np.full(-len(key) % k + k, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, k)
        windows = n - length + 1
        least = np.minimum(np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()[:windows],
                           np.minimum.accumulate(tiles, axis=1).ravel()[k - 1:k - 1 + windows])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fits = ends - starts >= length
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, starts[fits], 1)
        np.add.at(inside, ends[fits] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:windows]))
        new = np.flatnonzero(np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)])[:len(at)])
        self.first = at[new]
        self.count = np.diff(np.concatenate([new, [len(at)]]))
        self.at = anchor[self.first]
        self.h = mix(grams[self.at])

    def whole(self, which: np.ndarray) -> np.ndarray:
        """Fingerprints of the whole texts of the runs ``which``."""
        return self.text(self.first[which], self.count[which], self.at[which])

    def text(self, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the texts of window runs, with the place of the anchor."""
        x = (self.sums[first + count - 1 + self.shape.length] - self.sums[first]) * self.down[first]
        return mix(x + ((at - first) * 1_000_003 + count * 7_919).astype(np.uint64))

    def parts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, h, ext) of the parts of the runs ``which``: the windows whose
        distances to the anchor lie in one block of ``part``.  The new h is that of the
        text which all windows of the block share: the gram, extended to both sides."""
        size, length = self.shape.part, self.shape.length
        near = (self.at - self.first - self.count + 1)[which] // size
        n = (self.at - self.first)[which] // size - near + 1
        k = np.repeat(which, n)
        part = np.repeat(near, n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        right = self.at[k] - part * size  # last window of the block
        first = np.maximum(self.first[k], right - size + 1)
        count = np.minimum((self.first + self.count)[k], right + 1) - first
        common = (self.sums[right - size + 1 + length] - self.sums[right]) * self.down[right]
        h = mix(common + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER))
        return first, count, h, self.text(first, count, self.at[k])

    def windows(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, fingerprint) of the windows of runs."""
        start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return start, mix((self.sums[start + self.shape.length] - self.sums[start]) * self.down[start])


#: (letters, starts, ends, index of the first document, position of the letters in it)
Piece = tuple[np.ndarray, np.ndarray, np.ndarray, int, int]


def scan(step: str, shape: Shape, maps: list, pieces: Callable[[pa.Array], Iterator[Piece]], powers: Callable[[], Powers]):
    """Rows (id, pos, n, h, ext, again) of the runs of (id, k, t) batches, where ``k`` hashes the
    id: at step 'runs' those with a gram in the first map, at 'parts' the parts of the runs
    whose places are in the second, at 'windows' the windows of the parts whose places are in
    the third map.  A place is all of a document's runs with one text; ``again`` marks
    all but the first row of a place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(m.value, np.uint64) for m in maps]
        for b in batches:
            ids, keys = b.column("id"), b.column("k").to_numpy()
            met: tuple[int, set] = (-1, set())  # a document in several pieces: what was there before
            for letters, starts, ends, doc, base in pieces(b.column("t")):
                r = Runs(letters, starts, ends, shape, powers())
                if not len(r.first):
                    continue

                def place(first: np.ndarray, starts=starts, ends=ends, doc=doc, base=base):
                    which = np.searchsorted(ends, first, side="right")
                    return which + doc, first - starts[which] + base

                keep = np.flatnonzero(in_map(held[0], r.h))
                first, count, h, ext = r.first[keep], r.count[keep], r.h[keep], r.whole(keep)
                if step != "runs":
                    first, count, h, ext = r.parts(keep[in_map(held[1], marks(keys[place(first)[0]], ext))])
                    if step == "windows":
                        opened = in_map(held[2], marks(keys[place(first)[0]], ext))
                        first, h = r.windows(first[opened], count[opened])
                        count, ext = np.ones(len(first), np.int64), h
                if not len(first):
                    continue
                which, pos = place(first)
                again = _again(which, first, ext)
                if base or met[0] == doc:
                    if met[0] != doc:
                        met = (doc, set())
                    again |= np.fromiter((x in met[1] for x in ext.tolist()), bool, len(ext))
                if len(starts) == 1:
                    met = (doc, met[1] if met[0] == doc else set())
                    met[1].update(ext.tolist())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), pa.array(pos.astype(np.int64)), pa.array(count.astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array(ext.view(np.int64)), pa.array(again)],
                    names=["id", "pos", "n", "h", "ext", "again"])

    return run


ROWS = "pos long, n int, h long, ext long, again boolean"


def _again(which: np.ndarray, first: np.ndarray, ext: np.ndarray) -> np.ndarray:
    """Whether a row's document has its text further left."""
    order = np.lexsort((first, ext, which))
    same = (which[order][1:] == which[order][:-1]) & (ext[order][1:] == ext[order][:-1])
    out = np.zeros(len(which), bool)
    out[order[1:][same]] = True
    return out


#: Hashes that a task gathers before it deals them out.
GATHERED = 1 << 20
_DEALT = "bucket int, once binary, twice binary"


def repeated_grams(texts: DataFrame, shape: Shape, pieces: Callable[[pa.Array], Iterator[Piece]], powers: Callable[[], Powers],
                   buckets: int) -> DataFrame:
    """(h): the hashes of the anchors that come more than once.  Tasks sort and thin out
    what they find and deal it to hash ranges as packed arrays, so the shuffle moves about
    eight bytes an anchor and no row per anchor is made."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(h, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[:-1].astype(np.uint64)).tolist() + [len(h)]
            once, twice = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                once.append(h[lo:hi].tobytes())
                twice.append(h[lo:hi][n[lo:hi] > 1].tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(once, pa.binary()),
                                               pa.array(twice, pa.binary())], names=["bucket", "once", "twice"])

        size = 0
        for b in batches:
            for letters, starts, ends, _, _ in pieces(b.column("t")):
                h = Runs(letters, starts, ends, shape, powers()).h
                if len(h):
                    held.append(h)
                    size += len(h)
                if size >= GATHERED:
                    yield dealt()
                    size = 0
        if held:
            yield dealt()

    def repeats(table: pa.Table) -> pa.Table:
        def joined(name: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64)

        h = np.sort(joined("once"))
        found = np.union1d(h[1:][h[1:] == h[:-1]], joined("twice"))
        return pa.table({"h": pa.array(found.view(np.int64))})

    return texts.select("t").mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(repeats, "h long")


def hash_buckets(docs: DataFrame, text_col: str, bytes_an_anchor: int) -> int:
    """Hash ranges of about a million anchors each."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    return max(64, total // bytes_an_anchor // (1 << 20))


def marks(key: np.ndarray, ext: np.ndarray) -> np.ndarray:
    """Hash of a place: of its document's key and its fingerprint."""
    return mix(key.view(np.uint64) * np.uint64(MULTIPLIER) ^ mix(ext))


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a bit map may hold each hash: bit (h mod 64) of word (h / 64 mod size)."""
    word = (hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[word] >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame, most_bits: int):
    """The broadcast bit map of the hashes ``h``: about 16 bits for each, but never more than
    2**most_bits in all."""
    bits = min(most_bits, max(10, (16 * hashes.count()).bit_length()))
    size = 1 << (bits - 6)
    rows = hashes.select(
        F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(size - 1)).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def places(rows: DataFrame) -> DataFrame:
    """Hashes ``h`` of the places (first, ext): of documents' ids and fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, ext = (b.column(c).to_numpy() for c in ("k", "ext"))
            yield pa.RecordBatch.from_arrays([pa.array(marks(k, ext.view(np.uint64)).view(np.int64))], names=["h"])

    return rows.select(F.xxhash64("first").alias("k"), "ext").mapInArrow(run, "h long")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """The distinct (h, ext) of rows of :func:`scan`: smallest id and number of rows."""
    return rows.groupBy("h", "ext").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows"))


def open_places(found: DataFrame) -> DataFrame:
    """(first, ext) of the texts whose h comes with several texts: what is still to compare,
    one document for each text."""
    several = found.groupBy("h").agg(F.min("ext").alias("e0"), F.max("ext").alias("e1")).filter("e0 < e1").select("h")
    return found.join(several, "h", "left_semi").select("first", "ext")


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Overlapping and touching spans (in order of start) joined."""
    ends = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new].tolist(), ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])].tolist()


def cut_documents(src: DataFrame, spans: DataFrame, cut: Callable, schema) -> DataFrame:
    """``cut`` over the rows (..., i, t) of ``src`` joined with ``spans`` (i, s, e) on ``i``.  A bit
    map of the ids that have spans (a false positive costs a row's way) lets all other
    documents pass without a shuffle of their texts."""
    names = src.columns
    found = bitmap(spans.select(F.xxhash64("i").alias("h")), 26)

    def only(with_spans: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(found.value, np.uint64)
            for b in batches:
                some = in_map(bits, b.column("__k").to_numpy().view(np.uint64))
                b = b.filter(pa.array(some if with_spans else ~some))
                if not b.num_rows:
                    continue
                if with_spans:
                    yield b.select(names)
                else:
                    none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names if n != "i"), none, none],
                                                     names=[*(n for n in names if n != "i"), "s", "e"])
        return run

    keyed = src.withColumn("__k", F.xxhash64("i"))
    touched = keyed.mapInArrow(only(True), src.schema).join(spans, "i", "left").select(*(n for n in names if n != "i"), "s", "e")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(only(False)(batches))

    return touched.mapInArrow(cut, schema).unionByName(keyed.mapInArrow(untouched, schema))
