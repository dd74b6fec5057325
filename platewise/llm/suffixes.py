"""Suffix-array dedup with a logarithmic index family.

Texts are UTF-8 bytes.  A *window* is ``length`` consecutive bytes of one document.  A byte
is removed if a window that covers it also starts earlier: in a document with a smaller id, or
further left in the same one.  Windows are judged on the input.

**Suffixes.**  Every window has an *anchor*: the leftmost of its ``length - offsets + 1``-byte
grams with the least hash (``offsets`` is the largest power of two up to two thirds of the
length).  Equal windows have equal anchors, so the suffixes that start at anchors, about one
in ``offsets / 2`` bytes, suffice: a sampled suffix array.  A suffix stands for the run of
windows that chose its anchor, and is ordered by fingerprints of growing prefixes: that of its
gram (``h``), then that of the text of the whole run (``ext``).  The order isn't that of the
bytes, but equal texts are neighbours, which is all that a search for long matches needs.

**Family.**  Documents are taken in batches of ascending ids.  A batch gets its suffix array:
its distinct suffixes sorted by (h, ext), each with its first document.  It is merge-scanned
against every existing level (sorted merge on (h, ext)): a suffix that a level or an
earlier place of the batch has is a long match, and its whole run goes.  The other
suffixes become a level of their own; while the two last levels are of equal size they are
merged into one of twice the size, so n batches leave at most log2(n) + 1 levels and a suffix
is rewritten log2(n) times.  Levels hold a copy's suffixes once.

**Extension of partial matches.**  Suffixes with equal h but different ext share a gram and
perhaps some of their windows.  For the first documents of such suffixes (*open* ones) the run
is cut into eighths, aligned with the anchor, whose common text is the new h, and then into
single windows; each time only what is still open goes on.  Copies of a text take no
part in this: the first of them stands for all.

What bounds it: a suffix whose gram comes once can't match; a bit map of the repeated grams
(16 bits each, at most ``2**bitmap_bits`` in all) keeps those out of the family, others mark
the open places.
A false positive costs a row, never a result; when the maps fill up they merely cease
to save rows.  Groups of any size are aggregated on both sides of the shuffle or joined with a
side that has one row a key (AQE splits hot keys).  A task holds a few MB of text; documents
longer than that are cut into overlapping pieces.

Defined results: null and empty texts, and those shorter than a window, stay whole.  Rows that
repeat an id are taken to hold the same text and don't remove each other; rows with a null id
are kept as they are.  An empty table gives an empty result.  Only the id and text columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.anchors import (ROWS, Piece, Powers, Shape, bitmap, cut_documents, distinct_texts, hash_buckets, merged_spans, mix, open_places,
                                   places, repeated_grams, scan)
from platewise.llm.common import own_names, persisted, removed, worker_state

#: Bytes that a task works on at a time (its arrays fit a core's cache); longer documents are
#: cut at multiples of it.
PIECE = 1 << 17
EIGHTHS = 8
#: 64-bit values of the bytes.
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shape_of(length: int) -> Shape:
    """Grams a window: the largest power of two up to two thirds of the length."""
    offsets = 1
    while 3 * offsets * 2 <= 2 * length:
        offsets *= 2
    return Shape(length, offsets, offsets // EIGHTHS)


def _pieces(length: int, piece: int):
    """Several short documents together, long ones in pieces that share ``length - 1``
    bytes."""
    def run(column: pa.Array) -> Iterator[Piece]:
        wide = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        place = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(place, place[i] + piece, side="right")) - 1)
            starts, ends = place[i:j], place[i + 1:j + 1]
            if ends[-1] - starts[0] > piece:  # one long document
                for at in range(0, int(ends[0] - starts[0]) - length + 1, piece):
                    lo = int(starts[0]) + at
                    hi = min(int(ends[0]), lo + piece + length - 1)
                    yield LETTERS[text[lo:hi]], np.zeros(1, np.int64), np.array([hi - lo]), i, at
            elif ends[-1] - starts[0] >= length:
                yield LETTERS[text[starts[0]:ends[-1]]], starts - starts[0], ends - starts[0], i, 0
            i = j

    return run


def _powers() -> Powers:
    return worker_state(("powers",), lambda: Powers(PIECE + (1 << 12)))


def _scan(length: int, step: str, maps: list, piece: int = PIECE):
    return scan(step, shape_of(length), maps, _pieces(length, piece), _powers)


def _later(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, pos, n) of the ``rows`` that come after the first place of their suffix; without
    a first place all do."""
    after = F.col("first").isNull() | (F.col("id") > F.col("first")) | F.col("again")
    return rows.join(known.select("h", "ext", "first"), ["h", "ext"]).filter(after).select("id", "pos", "n")


class SuffixFamily:
    """Levels of sorted distinct suffixes in the shared folder, the newest last."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def _written(self, array: DataFrame) -> DataFrame:
        return persisted(array.select("h", "ext", "first").repartition("h", "ext").sortWithinPartitions("h", "ext"), "level")

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in the suffixes ``rows`` of a batch whose ids are above those of earlier ones;
        gives (id, pos, n): its window runs that begin earlier, in the family or the batch."""
        array = persisted(distinct_texts(rows), "suffix-array")
        fresh, matched = array, array.filter("n_rows > 1").select("h", "ext", "first")
        if self.levels:
            met = persisted(array.join(self.suffixes().select("h", "ext"), ["h", "ext"], "left_semi").select("h", "ext"), "met")
            fresh = array.join(met, ["h", "ext"], "left_anti")
            none = F.lit(None).cast(array.schema["first"].dataType)
            matched = matched.join(met, ["h", "ext"], "left_anti").unionByName(met.withColumn("first", none))
        self.levels.append((1, self._written(fresh)))
        matched_rows = persisted(matched, "matched")
        covered = persisted(_later(rows, matched_rows), "covered")
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels[-2:]
            self.levels[-2:] = [(2 * n, self._written(a.unionByName(b)))]
            removed(a)
            removed(b)
        removed(array)
        removed(matched_rows)
        return covered

    def suffixes(self) -> DataFrame:
        """The distinct suffixes of all levels."""
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out


def _batch_bounds(texts: DataFrame, batches: int) -> list:
    """Ids that cut the documents into about equal batches; none for ids without quantiles."""
    if batches < 2 or not isinstance(texts.schema["id"].dataType, T.NumericType):
        return []
    at = [i / batches for i in range(1, batches)]
    return sorted(set(texts.agg(F.percentile_approx("id", at, 1_000)).first()[0] or []))


def repeats(docs: DataFrame, length: int = 100, batches: int = 4, bitmap_bits: int = 28, id_col: str = "doc_id",
            text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, starts, ends): the repeated stretches of each document that has any, as arrays
    of byte positions in order of start; stretches may overlap."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("k"), F.col(text_col).cast("binary").alias("t"))
    schema, shape = f"id {kind}, {ROWS}", shape_of(length)
    grams = persisted(repeated_grams(texts, shape, _pieces(length, piece), _powers, hash_buckets(docs, text_col, shape.offsets // 2 or 1)),
                      "grams")
    maps = [bitmap(grams, bitmap_bits)]

    family, covered = SuffixFamily(), []
    bounds = [None, *_batch_bounds(texts, batches), None]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = texts if lo is None else texts.filter(F.col("id") > lo)
        part = part if hi is None else part.filter(F.col("id") <= hi)
        rows = persisted(part.mapInArrow(_scan(length, "runs", maps, piece), schema), "suffixes")
        covered.append(family.add(rows))
        removed(rows)
    removed(grams)

    # what only shares a gram: eighths of the open runs, then windows of the open eighths
    found = family.suffixes()
    for step in ("parts", "windows"):
        maps.append(bitmap(places(open_places(found)), bitmap_bits))
        rows = persisted(texts.mapInArrow(_scan(length, step, maps, piece), schema), step)
        removed(found)
        found = persisted(distinct_texts(rows), f"{step}-found")
        covered.append(persisted(_later(rows, found.filter("n_rows > 1")), "covered"))
        removed(rows)
    removed(found)
    spans = covered[0]
    for c in covered[1:]:
        spans = spans.unionByName(c)
    found = F.sort_array(F.collect_set(F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("n") - 1 + length).alias("e"))))
    # a document has at most as many as it has bytes
    return spans.groupBy("id").agg(found.alias("x")).select(
        F.col("id").alias(id_col), F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                for t, s, e in zip(b.column("t"), b.column("s"), b.column("e"), strict=True):
                    text = t.as_buffer().to_pybytes() if t.is_valid else b""
                    out, at, spans = [], 0, 0
                    if s.is_valid:
                        for x, y in zip(*merged_spans(s.values.to_numpy(), e.values.to_numpy()), strict=True):
                            out.append(text[at:x])
                            at, spans = y, spans + 1
                    out.append(text[at:])
                    kept.append(b"".join(out))
                    n_bytes.append(len(text))
                    n_removed.append(len(text) - len(kept[-1]))
                    n_spans.append(spans)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:len(names)], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=[*names, "__n_bytes", "__n_removed", "__n_spans", "__kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = 4, bitmap_bits: int = 28, id_col: str = "doc_id",
                   text_col: str = "text", carry: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default the id) with ``__n_bytes``,
    ``__n_removed``, ``__n_spans`` (maximal removed runs) and ``__kept`` (binary: what stays
    needn't be whole characters)."""
    carry = carry or [id_col]
    rows, (key, text) = own_names(docs, id_col, text_col)
    spans = persisted(repeats(rows, length, batches, bitmap_bits, key, text, piece), "spans").select(
        F.col(key).alias("i"), F.col("starts").alias("s"), F.col("ends").alias("e"))
    keep = [rows.columns[docs.columns.index(c)] for c in carry]
    src = rows.select(*[F.col(c) for c in keep], F.col(key).alias("i"), F.col(text).cast("binary").alias("t"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry]).add("__n_bytes", "long").add(
        "__n_removed", "long").add("__n_spans", "long").add("__kept", "binary")
    return cut_documents(src, spans, _cut(carry), schema)
