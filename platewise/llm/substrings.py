"""Substring dedup by seed and extend over winnowed anchors.

A *window* is ``length`` consecutive words of a document.  A word is removed if a window
that covers it also starts in a document with a smaller id; windows are judged on the
input.  So every maximal repeat of at least ``length`` words goes from all documents that
hold it but the first.

**Seeds.**  The hashes of all ``gram``-word grams are winnowed: each window's anchor is
the leftmost gram with the least hash among those inside it.  Equal windows have the same
anchor at the same place, so nothing longer than the threshold is missed, and a document
has about one anchor in six words.  An anchor stands for the run of windows that chose it.
Only grams that several documents have are seeds.

**Extension.**  A seed is extended in both directions to the text of its whole run, from the
first window to the end of the last.  Of each distinct extension the document with the
smallest id is kept; in all others the whole run repeats and goes.  That settles copies,
however many there are.  Seeds with several distinct extensions are *open*, and only the
first document of each extension goes on: its run is cut in two by the side on which its
windows need more of the context, and the gram is extended by half of the missing words to the
left or to the right.  What has that longer seed in common with others is settled or stays
open in the same way, and the parts that are still open end in single windows.

Seeds and open places are set in bit maps of at most ``2**bitmap_bits`` bits (a
parameter) that are broadcast, so a scan emits rows for these only.  A false positive of
the maps costs a row, never a result, since all comparisons are made on the rows; at sizes
where the maps fill up they merely cease to save rows.  Groups of any size are handled by
aggregates on both sides of the shuffle and by joins whose other side has one row a key
(AQE splits hot keys); no pairs of documents are made.

**Maximal repeats.**  Repeated runs and windows are merged per document into disjoint
spans of at least ``length`` words.

Hashes are 64-bit per gram and 64-bit per extension, used together.

Defined results: null and empty texts and those shorter than a window keep all words.
Rows that repeat an id are one document (its texts are taken to be equal) and don't
remove each other; rows with a null id are kept as they are.  An empty table gives an empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.anchors import (ROWS, Piece, Powers, Shape, bitmap, distinct_texts, hash_buckets, merged_spans, mix, open_places,
                                   places, repeated_grams, scan)
from platewise.llm.common import own_names, persisted, removed, steps, worker_state

#: Bytes of documents that a task works on at a time, and documents that it cuts at a time.
PIECE = 1 << 18
STEP = 1_000
#: Byte -> whether it is white space, and 64-bit values of the bytes.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers() -> Powers:
    return worker_state(("words",), lambda: Powers(PIECE + 4096))


def _word_hashes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes) of the words of documents that begin at ``starts``."""
    n = len(text)
    inside = ~_SPACE[text]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    first = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers().upto(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[text] * up[:n])])
    return first, mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def _pieces(column: pa.Array) -> Iterator[Piece]:
    """The words of about ``PIECE`` bytes of documents at a time, as hashes."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    place = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(place, place[i] + PIECE, side="right")) - 1)
        part = text[place[i]:place[j]]
        first, letters = _word_hashes(part, place[i:j] - place[i])
        cuts = np.searchsorted(first, place[i:j + 1] - place[i])
        yield letters, cuts[:-1], cuts[1:], i, 0
        i = j


def _later(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, pos, n) of the runs whose extension a document with a smaller id has."""
    several = found.filter("n_rows > 1").select("h", "ext", "first")
    return rows.join(several, ["h", "ext"]).filter("id > first").select("id", "pos", "n")


def repeats(docs: DataFrame, length: int = 13, gram: int = 4, bitmap_bits: int = 28, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, starts, ends): for each document with repeats, its repeated stretches as arrays
    of word positions in order of start; stretches may overlap."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("k"), F.col(text_col).cast("binary").alias("t"))
    shape = Shape(length, length - gram + 1, -(-(length - gram + 1) // 2))
    grams = persisted(repeated_grams(texts, shape, _pieces, _powers, hash_buckets(docs, text_col, 30)), "grams")
    maps, covered = [bitmap(grams, bitmap_bits)], []
    for step in ("runs", "parts", "windows"):
        rows = persisted(texts.mapInArrow(scan(step, shape, maps, _pieces, _powers), f"id {kind}, {ROWS}"), step)
        found = persisted(distinct_texts(rows), f"{step}-found")
        covered.append(persisted(_later(rows, found), "covered"))
        if step != "windows":
            maps.append(bitmap(places(open_places(found)), bitmap_bits))
        removed(rows)
        removed(found)
    spans = covered[0].unionByName(covered[1]).unionByName(covered[2])
    stretch = F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("n") - 1 + length).alias("e"))
    # a document has at most as many as it has words
    return spans.groupBy("id").agg(F.sort_array(F.collect_set(stretch)).alias("x")).select(
        F.col("id").alias(id_col), F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))


def _cut(names: list[str]):
    """(names, n_words, n_removed, kept) from (names, text, starts, ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, STEP):
            n_words, n_removed, kept = [], [], []
            for t, s, e in zip(*b.columns[-3:], strict=True):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                at, left = 0, []
                for lo, hi in zip(*merged_spans(s.values.to_numpy(), e.values.to_numpy()), strict=True) if s.is_valid else ():
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-3], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "__n_words", "__n_removed", "__kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 13, gram: int = 4, id_col: str = "doc_id",
                   text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default the id) with ``__n_words``, ``__n_removed``
    and ``__kept``: the words that stay, joined by one space."""
    carry = carry or [id_col]
    rows, (key, text) = own_names(docs, id_col, text_col)
    # the written spans have a known size: the planner broadcasts them only if small
    spans = persisted(repeats(rows, length, gram, id_col=key, text_col=text), "spans").select(
        F.col(key).alias("i"), F.col("starts").alias("s"), F.col("ends").alias("e"))
    keep = [rows.columns[docs.columns.index(c)] for c in carry]
    joined = rows.join(spans, F.col(key) == F.col("i"), "left").select(
        *keep, F.col(text).cast("binary").alias("t"), "s", "e")
    schema = T.StructType([docs.schema[c] for c in carry]).add("__n_words", "long").add(
        "__n_removed", "long").add("__kept", "string")
    return joined.mapInArrow(_cut(carry), schema)


def keep_unrepeated(docs: DataFrame, length: int = 13, gram: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with repeats cut from the texts (and ``size_col``, if named, set to the
    text's characters).  A document of which no word is left goes; texts without a
    repeat stay as they are."""
    rows, (key, words) = own_names(docs, id_col, text_col)
    out = remove_repeats(rows, length, gram, key, words, rows.columns).filter(
        (F.col("__n_removed") < F.col("__n_words")) | (F.col("__n_words") == 0))
    out = out.withColumn(words, F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col(words)))
    if size_col in docs.columns:
        size = rows.columns[docs.columns.index(size_col)]
        out = out.withColumn(size, F.length(words).cast(docs.schema[size_col].dataType))
    return out.select(*rows.columns).toDF(*docs.columns)
