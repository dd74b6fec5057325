"""SimHash near-dedup with covering locality-sensitive hashing.

**Fingerprint.**  Texts are lower-cased (A-Z), cut into words; each shingle of
``shingle`` consecutive words is hashed by XXH64 (seed 42) and a bit of the fingerprint
is 1 if it is set in over half the hashes (repeats count).

**Candidates.**  Fingerprints (distinct ones, with their smallest id) are hashed into
``2**(radius+1) - 1`` tables.  Bit i gets a vector phi(i) of ``radius + 1`` bits; the
mask of table v holds the bits with ``<phi(i), v> = 1 (mod 2)``, and the key is the
fingerprint under its mask.  Two fingerprints that differ in at most ``radius`` bits give
as many equations in ``radius + 1`` unknowns, so some v != 0 solves them: its mask
holds none of the differing bits and both collide there.  No pair is missed, whatever
the data; phi is fixed, hence so are the tables.

**Large buckets.**  A bucket with more than ``bucket`` fingerprints is not compared
all against all: inside it the same construction is applied to the bits outside its
mask.  These sub-tables again cover every pair within the radius (the differing bits lie
outside the mask), and each level halves the free bits, so at the third level a bucket
can't hold more than some hundreds of distinct fingerprints.

**Links.**  Within a bucket, a task joins the fingerprints at most ``radius`` bits
apart and emits a spanning forest of those links (at most one row per fingerprint and
bucket), not all pairs.  Components are found by alternating large-star and small-star
rounds on Spark, each written to the shared folder.

Defined results: a text without words has fingerprint 0 and is linked like any other;
fewer words than a shingle form one shingle; a null text has no words.  Repeated rows
share one fingerprint and so one component; ids repeat in the result as in the input.
Rows with a null id
link nothing by id: their component is the smallest id of their class, null if none.
An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed, own_names, persisted, steps, worker_state

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """XXH64 of every shingle of the normalised text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    cuts = map(slice, starts.tolist(), ends[shingle - 1:].tolist())
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(joined.__getitem__, cuts)),
                       np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit; 0 without hashes.  Whole bytes are counted per block."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        block = hashes[i:i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: the 64 bits as a signed number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("simhash",), object)  # nothing is kept
        for b in steps(batches, 1_000):
            fps = [fingerprint(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle))
                   for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"id {kind}, fp long")


def masks(radius: int, free: int = (1 << BITS) - 1, level: int = 0) -> list[int]:
    """The masks of the covering tables over the bits of ``free``.  phi deals the free
    bits evenly over the vectors of ``radius + 1`` bits, starting elsewhere each level."""
    n = 1 << (radius + 1)
    bits = [i for i in range(BITS) if free >> i & 1]
    out = []
    for v in range(1, n):
        phi = ((k * (2 * level + 1) + level) % n for k in range(len(bits)))
        out.append(sum(1 << b for b, p in zip(bits, phi, strict=True) if (p & v).bit_count() % 2))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(radius: int, levels: int) -> list[list[tuple[int, int]]]:
    """For each level its (table, mask); table t of a level lies in table t // n of the
    level above, where n is the number of tables that cover a bucket."""
    everything = (1 << BITS) - 1
    out = [list(enumerate(masks(radius)))]
    for level in range(1, levels):
        out.append([])
        for _, above in out[level - 1]:
            for m in masks(radius, everything & ~above, level):
                out[level].append((len(out[level]), above | m))
    return out


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most ``radius`` bits apart (each tree's edges
    point to its smallest member)."""
    v = values.astype(np.uint64)
    todo = np.ones(len(v), bool)
    out = []
    for root in range(len(v)):  # breadth first from each value not reached yet
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            at = front.pop()
            left = np.flatnonzero(todo)
            near = left[np.bitwise_count(v[left] ^ v[at]) <= radius]
            todo[near] = False
            front.extend(near.tolist())
            out.extend((int(v[root]), int(v[x])) for x in near)
    return out


def _links_of(radius: int, level: int):
    """Links of the buckets of a task, which are sorted by (table, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def close() -> list[tuple[int, int]]:
            v = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            return bucket_links(v.view(np.uint64), radius) if len(v) > 1 else []

        for b in batches:
            t, k, v = (b.column(c).to_numpy() for c in ("t", "key", "fp"))
            edges = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            out = []
            for lo, hi in zip([0, *edges], [*edges, len(t)], strict=True):
                if lo == hi:
                    continue
                if (t[lo], k[lo]) != now:
                    out += close()
                    now, held = (t[lo], k[lo]), []
                held.append(v[lo:hi])
            yield _pairs(out)
        yield _pairs(close())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def links(fps: DataFrame, radius: int = 2, bucket: int = 256, levels: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` at most ``radius`` bits apart
    that connect everything such pairs connect."""
    spark = fps.sparkSession
    tables = _tables(radius, levels)
    n = len(tables[0])
    parts, rows = [], fps.select("fp", F.lit(0).alias("above"))
    for level, known in enumerate(tables):
        last = level == levels - 1
        # the tables inside the table a fingerprint came from
        mask = F.create_map(*[F.lit(x) for t, m in known for x in (t, _signed(m))]) if level == 0 else None
        if level == 0:
            keyed = rows.withColumn("t", F.explode(F.array(*[F.lit(t) for t, _ in known])))
            keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(mask[F.col("t")]))
        else:
            ms = spark.createDataFrame([(t // n, t, _signed(m)) for t, m in known], "above int, t int, mask long")
            # n**(level+1) rows: a number fixed by the radius
            keyed = rows.join(F.broadcast(ms), "above").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = keyed.select("t", "key", "fp")
        if not last:
            keyed = persisted(keyed, "simhash-tables")
            hot = persisted(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
                            .filter(F.col("n") > bucket).select("t", "key"), "simhash-hot")
            any_hot = not hot.isEmpty()
            if any_hot:
                rows = keyed.join(hot, ["t", "key"], "left_semi").select("fp", F.col("t").alias("above"))
                keyed = keyed.join(hot, ["t", "key"], "left_anti")
        parts.append(keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(
            _links_of(radius, level), "a long, b long"))
        if last or not any_hot:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node in ``pairs``
    (a, b), by alternating large-star and small-star rounds until nothing changes."""
    edges = checkpointed(pairs.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: larger neighbours of a node go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct())
        # small star: smaller neighbours of a node, and itself, go to the least of them
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        small = checkpointed(small.distinct())
        # done when every edge points to a root: no node is on both sides
        if small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() \
                and small.groupBy("u").count().filter("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of the written fingerprints ``rows`` (id, fp)."""
    firsts = persisted(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    member = components(links(firsts.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    roots = firsts.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = persisted(roots.groupBy("root").agg(F.min("first").alias("component")), "simhash-least")
    return persisted(roots.join(least, "root").select("fp", "component"), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of
    fingerprints at most ``radius`` bits apart."""
    rows = persisted(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    return rows.join(_classes(rows, radius), "fp").select(F.col("id").alias(id_col), "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with their own columns;
    of rows that repeat an id one stays, rows without an id all stay."""
    rows, (key, text) = own_names(docs, id_col, text_col)
    found = persisted(near_duplicates(rows, shingle, radius, key, text).filter(
        F.col(key).isNotNull()).select(F.col(key).alias("__id"), "component"), "simhash-components")
    # written, so the planner knows its size: broadcast if small, else a shuffle
    gone = persisted(found.filter("__id <> component").select("__id").distinct(), "simhash-gone")
    out = rows.join(gone, F.col(key) == F.col("__id"), "left_anti")
    if not found.groupBy("__id").count().filter("count > 1").isEmpty():
        unnamed = F.col(key).isNull()
        out = out.filter(~unnamed).dropDuplicates([key]).unionByName(out.filter(unnamed))
    return out.toDF(*docs.columns)
