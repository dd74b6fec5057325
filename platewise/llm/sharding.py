"""Sharding by a minimax contiguous partition.

Documents with equal texts form a group that is never cut.  Groups are ordered by the
64-bit hash of their text and the hash space is cut into ``2**atom_bits`` equal ranges:
the ordered *atoms*.  An atom holds whole groups, so a cut between atoms splits none,
and the number of atoms is a fixed parameter, which bounds what reaches the driver (one
size and one count per atom, 65,536 by default, whatever the input).

On those ordered atom sizes the smallest capacity is found by binary search; each
capacity is checked greedily (fill a shard until the next atom would exceed it), and the
atoms are cut at the optimum.  So the largest shard is the least possible for a
contiguous partition of the atoms.  Each document then gets its shard from its
atom alone: a literal table of the shards' first atoms, no join, no shuffle.

Slots number the rows of a shard without gaps.  Rows (ids and sizes only, no text) are
range-partitioned by (atom, id), so a group that holds a third of all rows is spread
over many tasks, numbered inside each partition, and shifted by exact offsets.

Defined results: null text -> no bytes, CRC of the empty text, grouped with the empty
texts.  Repeated rows take separate slots in one shard.  More shards than atoms leave
the last shards empty; an empty table gives an empty result.  Input columns other than
id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed

ROW_OVERHEAD = 16
_LOW33 = (1 << 33) - 1


def greedy_cuts(sizes: np.ndarray, capacity: int) -> list[int]:
    """First atoms of the shards when each is filled up to ``capacity``."""
    ends = np.cumsum(sizes)
    starts, at, done = [], 0, 0
    while at < len(sizes):
        starts.append(at)
        nxt = int(np.searchsorted(ends, done + capacity, side="right"))
        if nxt == at:
            raise ValueError("an atom exceeds the capacity")
        at, done = nxt, int(ends[nxt - 1])
    return starts


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which ``shards`` contiguous runs hold all atoms, and
    the first atom of each run (at most ``shards`` of them).

    At that capacity a cut may lie anywhere between the last place from which the rest
    still fits and the first place where the run before it is full; it is put as close
    to its equal share as this allows, so the last run doesn't take all the slack."""
    if len(sizes) == 0:
        return 0, []
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(sizes, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = int(ends[-1])
    earliest = [0] * (shards + 1)  # [j]: least start of run j from which runs j.. hold the rest
    earliest[shards] = len(sizes)
    for j in range(shards - 1, -1, -1):
        earliest[j] = int(np.searchsorted(ends, ends[earliest[j + 1]] - low, side="left"))
    starts = [0]
    for j in range(1, shards):
        full = int(np.searchsorted(ends, ends[starts[-1]] + low, side="right")) - 1
        share = total * j / shards
        at = int(np.searchsorted(ends, share))
        if at and share - ends[at - 1] < ends[min(at, len(sizes))] - share:
            at -= 1
        at = min(max(at, earliest[j], starts[-1] + 1), full)
        if at >= len(sizes):
            break
        starts.append(at)
    return low, starts


def _shard_of(atom: Column, firsts: list[int], shards: range | None = None) -> Column:
    """Number of the run that holds ``atom``: a binary tree of comparisons."""
    shards = shards or range(len(firsts))
    if len(shards) <= 1:
        return F.lit(shards[0] if len(shards) else 0)
    mid = len(shards) // 2
    return F.when(atom < firsts[shards[mid]], _shard_of(atom, firsts, shards[:mid])).otherwise(
        _shard_of(atom, firsts, shards[mid:]))


def shard(docs: DataFrame, shards: int = 40, atom_bits: int = 16, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, atom, shard, slot) for every row; law: bytes near equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # checkpointed: ids and sizes only, so that counts, ranges and rows agree
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - atom_bits).cast("int").alias("atom"))
    ranged = checkpointed(
        rows.repartitionByRange(F.col("atom"), F.col("id")).sortWithinPartitions("atom", "id")
        .withColumn("mid", F.monotonically_increasing_id()))
    # at most one row per atom plus one per partition boundary
    part = F.shiftright("mid", 33).cast("int")
    atoms = ranged.groupBy(part.alias("part"), "atom").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes, counts = np.zeros(1 << atom_bits, np.int64), np.zeros(1 << atom_bits, np.int64)
    in_part: dict[int, int] = {}
    for r in atoms:
        sizes[r["atom"]] += r["size"]
        counts[r["atom"]] += r["n"]
        in_part[r["part"]] = in_part.get(r["part"], 0) + r["n"]
    used = np.flatnonzero(counts)
    _, cuts = minimax_cuts(sizes[used], shards)
    firsts = [int(used[c]) for c in cuts]
    before = np.concatenate([[0], np.cumsum(counts)])
    shard_first = [int(before[f]) for f in firsts]
    offsets, done = [], 0
    for p in range(max(in_part, default=-1) + 1):
        offsets.append(done)
        done += in_part.get(p, 0)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array(F.lit(0).cast("long"))
    out = ranged.withColumn("shard", _shard_of(F.col("atom"), firsts).cast("int"))
    at = F.get(longs(offsets), part) + F.col("mid").bitwiseAND(F.lit(_LOW33))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "atom", "shard",
                      (at - F.get(longs(shard_first), F.col("shard"))).alias("slot"))
