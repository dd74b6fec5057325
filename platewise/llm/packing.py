"""Variable-capacity best-fit packing of documents into training sequences.

Items are documents with a length (words plus one end mark by default); one longer than the
largest capacity is cut into pieces of that capacity and a rest.  Several sequence
lengths are permitted, and optimised jointly: items are placed in decreasing length; each
goes into the open bin, of whatever capacity, that it leaves with the least room; if none
has room, the bin size of least cost is opened, and finally each bin is downsized to the
smallest permitted capacity that holds its contents.

Cost of a sequence of capacity c: ``c + c * c / quadratic`` (linear layers plus
attention).  Opening c for an item of length s costs that, less what its free room will
save: ``fill * (c - s)`` tokens at the least cost per token of any capacity.

Items are dealt by the hash of (id, piece) into groups of about ``group`` items and each
group is packed by itself: a group is bounded, no key decides it, so no id or source is
hot, and more input makes more groups, not larger ones.

Defined results: a null or empty text is an item of length 1 (its end mark).  Repeated rows are
items of their own.  Ties go to the smaller id and piece, then to the bin opened first;
an empty table gives an empty result.  Only the id and the length's column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import words

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 2048


def cost(capacity: int, quadratic: float) -> float:
    return capacity + capacity * capacity / quadratic


def opening(capacities: tuple[int, ...], quadratic: float, fill: float) -> list[int]:
    """The capacity to open for an item of each length from 0 to the largest."""
    unit = min(cost(c, quadratic) / c for c in capacities)
    return [min((cost(c, quadratic) - fill * unit * (c - s), c) for c in capacities if c >= s)[1]
            for s in range(max(capacities) + 1)]


def best_fit(lengths: list[int], capacities: tuple[int, ...], quadratic: float = 8192.0,
             fill: float = 0.95) -> tuple[list[int], list[int], list[int]]:
    """Packs items in the given order: (bin of each item, its offset, final capacity of
    each bin).  Open bins are kept by their room; a bit per room finds the least one
    that an item fits in."""
    opens = opening(capacities, quadratic, fill)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some open bin has room r
    bins, offsets, used, sizes = [], [], [], []
    for s in lengths:
        above = rooms >> s
        if above and s:
            r = s + (above & -above).bit_length() - 1
            held = by_room[r]
            b = held.pop(0)
            if not held:
                rooms &= ~(1 << r)
        else:
            b = len(used)
            used.append(0)
            sizes.append(opens[s])
            r = sizes[b]
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if left := r - s:
            held = by_room.setdefault(left, [])
            at = len(held)  # kept in order of opening
            while at and held[at - 1] > b:
                at -= 1
            held.insert(at, b)
            rooms |= 1 << left
    ordered = sorted(capacities)
    final = [next(c for c in ordered if c >= u) for u in used]
    return bins, offsets, final


_PACKED = "group int, id {kind}, piece int, length int, bin int, offset int, capacity int, used int"


def _packer(capacities: tuple[int, ...], quadratic: float, fill: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and, in it, by the packing order."""
        for g, held in _groups(batches):
            lengths = held.column("length").to_pylist()
            bins, offsets, final = best_fit(lengths, capacities, quadratic, fill)
            used = np.bincount(bins, weights=lengths, minlength=len(final)).astype(np.int32)
            i32 = lambda x: pa.array(np.asarray(x, np.int32))
            yield pa.RecordBatch.from_arrays(
                [i32([g] * len(bins)), held.column("id").combine_chunks(), held.column("piece").combine_chunks(),
                 held.column("length").combine_chunks(), i32(bins), i32(offsets), i32(np.array(final)[bins]), i32(used[bins])],
                names=["group", "id", "piece", "length", "bin", "offset", "capacity", "used"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(group, its rows) of batches sorted by group; one group is held at a time."""
    parts: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        g = b.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if parts and g[lo] != now:
                yield now, pa.Table.from_batches(parts)
                parts = []
            now = int(g[lo])
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield now, pa.Table.from_batches(parts)


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
         quadratic: float = 8192.0, fill: float = 0.95, group: int = GROUP, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, bin, offset, capacity, used): where each piece of each
    document lies; ``bin`` is unique over all groups, ``start`` counts in the document."""
    largest = max(capacities)
    n = F.size(words(F.col(text_col))) + 1 if length is None else length
    items = docs.select(F.col(id_col).alias("id"), n.cast("long").alias("n"))
    # a row per piece: as many as the text needs
    pieces = items.select("id", "n", F.explode(F.sequence(
        F.lit(0), F.greatest(F.ceil(F.col("n") / largest).cast("int") - 1, F.lit(0)))).alias("piece")).select(
        "id", "piece", F.least(F.col("n") - F.col("piece").cast("long") * largest, F.lit(largest)).cast("int").alias("length"))
    groups = max(1, -(-docs.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "id", "piece").mapInArrow(
        _packer(tuple(capacities), quadratic, fill), _PACKED.format(kind=kind))
    return packed.select(
        F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * largest).alias("start"), "length",
        (F.col("group").cast("long") * (1 << 32) + F.col("bin")).alias("bin"), "offset", "capacity", "used")
