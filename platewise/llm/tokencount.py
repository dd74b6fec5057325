"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier 1 is a hash table of frequent pre-tokens and their numbers of tokens, broadcast once:
at most ``entries`` pre-tokens of at most ``MAX_LENGTH`` characters, so its size is bounded
whatever the corpus.  It is gathered from about ``fit_rows`` rows, whatever their number; it only
decides which tier answers, never a count.  Tier 2 is a cache in each Python worker, also
bounded; what neither holds is encoded by the tokenizer library and cached.  Counts are
sums over the pre-tokens of a whole text, so documents are counted where they are read and no
pre-token is ever shuffled.

The pre-token pattern is the byte-level one.  A few characters that were assigned or
reclassified between Unicode versions are cut otherwise by the library than by the
pattern; they are found once, by asking both about every character of the basic plane,
and texts with one of them, or with a character beyond that plane, are counted by the
library as a whole.  Special tokens inside a text count as one token, as is the
library's default.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are independent, so
repeated rows repeat their counts; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import worker_state

ENTRIES = 65_536
FIT_ROWS = 4_096
MAX_LENGTH = 32
CACHED = 500_000


class _Library:
    """The tokenizer of a worker, and how its texts are cut."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = regex.compile(pattern).findall
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        pre = self.tokenizer.pre_tokenizer
        odd = []
        for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
            probe = f"a{chr(c)}1{chr(c)} {chr(c)}"
            if [probe[a:b] for _, (a, b) in pre.pre_tokenize_str(probe)] != self.cut(probe):
                odd.append(chr(c))
        self.odd = regex.compile(f"[{''.join(map(regex.escape, odd))}\U00010000-\U0010FFFF]")

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class _Lengths(dict):
    """Tier 1 (the dict itself), then tier 2, then the library."""

    def __init__(self, frequent: dict[str, int], library: _Library):
        super().__init__(frequent)
        self.library, self.cache = library, {}

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.library.encoded(piece)
            if len(piece) <= MAX_LENGTH:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = n
        return n


def _library(path: str, pattern: str) -> _Library:
    return worker_state(("library", path, pattern), lambda: _Library(path, pattern))


def count_text(text: str, lengths: _Lengths) -> int:
    lib = lengths.library
    if lib.odd.search(text):
        return lib.encoded(text)
    if lib.special and (found := lib.special.findall(text)):
        return len(found) + sum(count_text(x, lengths) for x in lib.special.split(text))
    return sum(map(lengths.__getitem__, lib.cut(text)))


def frequent_lengths(docs: DataFrame, path: str, pattern: str, entries: int = ENTRIES, fit_rows: int = FIT_ROWS,
                     id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """The most frequent pre-tokens of about ``fit_rows`` rows (those whose ids have the
    smallest hashes), counted in tasks and merged by an aggregate, with their numbers of
    tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _library(path, pattern).cut
        for b in batches:
            c: Counter[str] = Counter()
            for t in b.column(0):
                c.update(x for x in cut(t.as_py()) if len(x) <= MAX_LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())],
                                             names=["piece", "n"])

    share = min(1.0, fit_rows / max(1, docs.count()))
    small = F.xxhash64(id_col) <= int((share - 0.5) * (2**64 - 2**12))
    sample = docs.filter(small & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    top = sample.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "piece").limit(entries).select("piece").toArrow()
    lib = _library(path, pattern)
    return {p: lib.encoded(p) for p in top.column("piece").to_pylist()}


def count_tokens(docs: DataFrame, path: str, pattern: str, entries: int = ENTRIES, fit_rows: int = FIT_ROWS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every document.  ``path``: a tokenizer file on every
    worker."""
    frequent = docs.sparkSession.sparkContext.broadcast(
        frequent_lengths(docs, path, pattern, entries, fit_rows, id_col, text_col))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_state(("lengths", name), lambda: _Lengths(frequent.value, _Library(path, pattern)))
        for b in batches:
            texts = b.column(1)
            n = [count_text(t.as_py(), lengths) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(id_col, text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n")) \
        .mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
