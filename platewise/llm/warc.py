"""WARC archives: writing one record per row, reading by boundary-chain verification.

**Writing.**  A record is a header block, a blank line, the block and two line ends; Spark's
text writer puts the records into the archive files of a folder (one file a task, in the
shared file system).  Of records with equal payloads of at least ``min_revisit`` bytes the
one with the smallest id is a ``response``; the others are ``revisit`` records without a
block that name it.  Digests are grouped with map-side minima; only the ids of revisits
are joined back, from a written table whose size the planner sees (broadcast if small,
else a shuffle).

**Reading.**  An archive is scanned in splits, by many tasks.  ``WARC/1.`` is used as the
line separator of Spark's text reader, so each row after a separator is a *candidate*
record, whether the magic stands at a boundary or inside a payload.  A candidate's
header gives its length, hence the offset of its successor.

1. Each task walks its split's candidates backwards once and follows successor links
   inside the split (pointer jumping with path compression), so a candidate knows where
   its chain leaves the split.  Only candidates that a chain from outside could enter
   matter further; what remains is one link per split and entry.
2. Across splits, pointer jumping by doubling: each round joins the set of reached
   offsets and the jump links with themselves, until the file starts reach nothing new.
   The number of rounds is the logarithm of the number of splits of a file.
3. The entry of each split (a row per split) goes back to the scan; the task keeps
   exactly the candidates on the chain.  Magic inside payloads is never on the chain,
   and its segments are put back into the payload they came from, also across splits.

A file that doesn't begin with a record has no reachable record; a chain that ends at an
offset without a candidate stops there, and what follows is not returned.

Defined results: a null id is written as an empty one and never revisits; null payloads are written as empty blocks, repeated rows give one record
each (equal payloads: the smallest id responds, a repeated smallest id responds each
time), an empty table gives an empty archive; other input columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed, persisted

MAGIC = "WARC/1."
END = "\r\n\r\n"
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
DATE = "2026-01-01T00:00:00Z"
#: Rows of the split table (about 100 bytes each) that are broadcast at a time.
BROADCAST_SPLITS = 100_000


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
            min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(id, uri, payload, digest, refers_to) of each page; refers_to is set, and the
    record is a revisit, where an equal payload has a smaller id."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"),
                        F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    digests = persisted(rows.filter(F.octet_length("payload") >= min_revisit).select(
        "id", F.unhex("digest").alias("key")), "warc-digests")
    firsts = digests.groupBy("key").agg(F.min("id").alias("refers_to"), F.max("id").alias("last"))
    shared = persisted(firsts.filter("last > refers_to").drop("last"), "warc-shared")
    later = persisted(digests.join(shared, "key").filter("id > refers_to").distinct(), "warc-later")
    return rows.withColumn("key", F.unhex("digest")).join(later, ["id", "key"], "left").drop("key")


def record_text(uri: Column, rid: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record without its two closing line ends."""
    response = refers_to.isNull()
    block = F.when(response, payload).otherwise(F.lit(b""))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"\r\nWARC-Record-ID: <{RECORD_ID}"), F.coalesce(rid.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(uri, r"[\x00-\x1F]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nX-Payload-Length: "), F.octet_length(payload).cast("string"),
        F.when(response, "").otherwise(F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{RECORD_ID}"), refers_to.cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head.cast("binary"), block).cast("string")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
               payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive files of ``pages`` into the folder ``path``."""
    r = records(pages, id_col, uri_col, payload_col, min_revisit)
    r.select(record_text(F.col("uri"), F.col("id"), F.col("payload"), F.col("digest"), F.col("refers_to"))
             .alias("value")).write.option("lineSep", END).text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def record_length(segment: bytes) -> int:
    """Bytes of a candidate record from its magic to its last line end, as its header
    says; 0 if it has no such header.  ``segment``: what follows the magic."""
    end = segment.find(b"\r\n\r\n")
    if end < 0 or segment[1:3] != b"\r\n" or not segment[:1].isdigit():
        return 0
    m = _LENGTH.search(segment, 0, end + 2)
    return len(MAGIC) + end + 4 + int(m[1]) + 4 if m else 0


def _segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, segment): what stands between the magics, in order within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("segment"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((file, split, ...), segments) of each split of a task.  A task reads its splits
    one after the other; only the current segment is held."""
    def rows():
        for b in batches:
            cols = [b.column(n).to_pylist() for n in b.schema.names if n != "segment"]
            yield from zip(zip(*cols, strict=True), b.column("segment"), strict=True)

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, (s.as_buffer().to_pybytes() for _, s in group)


_LINKS = "file string, split long, bytes long, rel long, tail long, exit long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each candidate of a split: its place, the last record of its chain in the
    split and the place where the chain leaves it, counted from the split's first row.
    A row with rel = null has the split's length.  A magic counts with the row after it;
    only the first row of a file follows none."""
    for (file, split), segments in _splits(batches):
        at, places, tails, exits = 0, [], {}, {}
        for k, segment in enumerate(segments):
            if k or split:
                if length := record_length(segment):
                    places.append(at)
                    exits[at] = at + length
                at += len(MAGIC)
            at += len(segment)
        for p in reversed(places):  # successors first: each link becomes the whole jump
            nxt = exits[p]
            tails[p], exits[p] = tails.get(nxt, p), exits.get(nxt, nxt)
        n = len(places)
        yield pa.RecordBatch.from_arrays([
            pa.array([file] * (n + 1)), pa.array([split] * (n + 1), pa.int64()), pa.array([at] * (n + 1), pa.int64()),
            pa.array([None, *places], pa.int64()), pa.array([None, *(tails[p] for p in places)], pa.int64()),
            pa.array([None, *(exits[p] for p in places)], pa.int64())],
            names=["file", "split", "bytes", "rel", "tail", "exit"])


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: ``base`` (offset of its first row), ``bytes``, ``entry`` (first
    reached offset in it, null: none), ``open`` and ``open_end`` (the reached record that
    began in an earlier split, and where it ends)."""
    links = persisted(_segments(spark, path).mapInArrow(_links, _LINKS), "warc-links")
    by_file = Window.partitionBy("file").orderBy("split")
    splits = persisted(links.filter("rel is null").select("file", "split", "bytes").withColumn(
        "base", F.sum("bytes").over(by_file) - F.col("bytes")), "warc-splits")
    links = links.filter("rel is not null").drop("bytes").join(splits.drop("bytes"), ["file", "split"]).select(
        "file", "split", *[(F.col("base") + F.col(c)).alias(n) for c, n in (("rel", "at"), ("tail", "tail"), ("exit", "exit"))])
    # chains enter a split only where another one left: other candidates need no jump
    landed = links.select("file", F.col("exit").alias("at")).distinct()
    starts = links.filter("at = 0")
    nodes = checkpointed(links.join(landed, ["file", "at"], "left_semi").unionByName(starts).distinct())
    jumps, reached = nodes.select("file", "at", "exit"), checkpointed(starts.select("file", "at"))
    known = reached.count()
    while True:
        reached = checkpointed(reached.unionByName(
            reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
            .join(nodes.select("file", "at"), ["file", "at"], "left_semi")).distinct())
        found = reached.count()
        if found == known:
            break
        known = found
        ahead = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jumps = checkpointed(jumps.join(ahead, ["file", "exit"], "left").select(
            "file", "at", F.coalesce("far", "exit").alias("exit")))
    entered = nodes.join(reached, ["file", "at"], "left_semi").select(
        "file", "split", F.col("at").alias("entry"), "tail", "exit")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    return splits.join(entered, ["file", "split"], "left").withColumns({
        "open": F.last("tail", ignorenulls=True).over(before),
        "open_end": F.last("exit", ignorenulls=True).over(before)})


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "x-payload-length")
_RECORD = ("file string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_length long, payload binary")
_RECORD_TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
_RECORD_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_PIECE = "file string, at long, piece_at long, data binary"


def _parsed(file: str, at: int, data: bytes) -> tuple:
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind, rid, uri, ref, digest, length = (fields.get(f) for f in _FIELDS)
    bare = lambda x: x and x.strip("<>")
    return (file, at, kind, bare(rid), uri, bare(ref), digest and digest.rpartition(":")[2],
            int(length) if length and length.isdigit() else None, data[end + 4:-4])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, record, piece, data, whole) of what the chain reaches in each split."""
    for (file, split, base, entry, begun, begun_end), segments in _splits(batches):
        if base is None:
            raise RuntimeError(f"split {split} of {file} was not in the first scan")
        at, due = base, entry
        record, end = (begun, begun_end) if begun is not None and begun_end > base else (None, 0)
        first, data = base, []
        for k, segment in enumerate(segments):
            magic = MAGIC.encode() if k or split else b""
            if magic and at == due:
                if record is not None and data:
                    yield file, record, first, b"".join(data), first == record
                record, first, data = at, at, []
                end = due = at + record_length(segment)
            if record is not None and at < end:
                data.append(magic + segment)
            at += len(magic) + len(segment)
        if record is not None and data:
            yield file, record, first, b"".join(data), first == record and at >= end


def _batched(rows: Iterator[tuple], names: list[str], types: list, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``most`` bytes of the last column."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (_parsed(f, r, d) for f, r, _, d, whole in _walked(batches) if whole)
    return _batched(rows, _RECORD_NAMES, _RECORD_TYPES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((f, r, p, d) for f, r, p, d, whole in _walked(batches) if not whole)
    return _batched(rows, ["file", "at", "piece_at", "data"], [pa.string(), pa.int64(), pa.int64(), pa.binary()])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for r in b.to_pylist():
                data = b"".join(p["data"] for p in r["pieces"])
                if len(data) >= record_length(data[len(MAGIC):]):  # else the file ends within it
                    yield _parsed(r["file"], r["at"], data)

    return _batched(rows(), _RECORD_NAMES, _RECORD_TYPES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path``: file, offset, record_type, record_id,
    target_uri, refers_to, payload_digest and payload_length (as declared), payload."""
    entries = persisted(_entries(spark, path), "warc-entries")
    # one row per split: a broadcast holds about BROADCAST_SPLITS rows, and beyond that the
    # archives are read in several groups of files, each with its own
    deals = max(1, -(-entries.count() // BROADCAST_SPLITS))
    scan = None
    for g in range(deals):
        mine, files = entries, path
        if deals > 1:
            mine = entries.filter(F.pmod(F.xxhash64("file"), F.lit(deals)) == g)
            files = [r["file"] for r in mine.select("file").distinct().collect()]  # the scan's own list of files
            if not files:
                continue
        here = _segments(spark, files).join(
            F.broadcast(mine.select("file", "split", "base", "entry", "open", "open_end")), ["file", "split"], "left").select(
            "file", "split", "base", "entry", "open", "open_end", "segment")
        scan = here if scan is None else scan.unionByName(here)
    out = scan.mapInArrow(_whole, _RECORD)
    if entries.filter("exit > base + bytes").isEmpty():
        return out
    pieces = scan.mapInArrow(_pieces, _PIECE).groupBy("file", "at").agg(
        F.sort_array(F.collect_list(F.struct("piece_at", "data"))).alias("pieces"))  # as large as the record
    return out.unionByName(pieces.mapInArrow(_joined, _RECORD))
