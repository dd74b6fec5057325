"""Language identification by cross-parsing entropy.

**Model.**  For each language a suffix automaton of labelled running text: the whole texts of
a bounded sample of its rows, case-folded, with every run of characters that aren't letters
as one space.  The bounds ``rows`` (rows per language) and ``languages`` (the labels with
most rows) are parameters; the rows are those with the smallest hashes of their ids, so the
sample doesn't depend on order or partitioning.  Only the sampled texts travel to the
workers, which build the automata once.

**Cross-parsing.**  A text, prepared in the same way, is parsed from left to right into
phrases, each the longest match anywhere in the language's text, across words (a character
that it doesn't hold is a phrase of its own).  The cross entropy of a language is
``phrases * log2(size of its text) / characters``; the lowest wins, ties go to the smaller
name.  Fewest normalised phrases thus win, and a longer labelled text gives no advantage
by its size alone.

The score is ``1 - best / second`` of the cross entropies (1 if a single language is
known): 0 for a tie, near 1 for a clear winner.

Defined results: a null text, a text without a letter, or a model without languages
gives ``und`` and score 0.  Repeated rows get equal results, whole texts are parsed,
columns other than id and text don't enter a prediction, an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import own_names, worker_state

UNKNOWN = "und"
#: Texts that a worker parses together and their bytes (one text may have more), and the
#: least number worth reading in step.
IN_HAND = 3_000
BYTES_IN_HAND = 4_000_000
IN_STEP = 20


class SuffixAutomaton:
    """Automata of all substrings of texts (online construction), one per text, in one
    table of transitions: state * letters + letter -> state, or -1.  The last letter stands
    for all characters that no text has; it has no transitions."""

    def __init__(self, texts: list[str]):
        every = sorted(set().union(*texts))
        self.letters = len(every) + 1
        self.code = np.full(0x110000, len(every), np.uint8 if len(every) < 256 else np.int32)
        self.code[[ord(c) for c in every]] = np.arange(len(every))
        self.size = np.array([len(t) for t in texts])
        self.roots: list[int] = []
        self.table = array("i")  # grown in place: a copy of it is as large as all else in a worker
        for t in texts:
            self.roots.append(len(self.table) // self.letters)
            self._add(self.coded(t), self.roots[-1])
        self.steps = np.frombuffer(self.table, np.int32) if self.table else np.zeros(0, np.int32)

    def coded(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _add(self, codes: np.ndarray, base: int) -> None:
        width, nxt = self.letters, self.table
        none = array("i", [-1]) * width
        nxt.extend(none)
        link, length = array("i", [-1]), array("i", [0])  # of the states from ``base`` on
        last = 0
        for c in codes.tolist():
            cur = len(link)
            nxt.extend(none)
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and nxt[(p + base) * width + c] < 0:
                nxt[(p + base) * width + c] = cur + base
                p = link[p]
            if p != -1:
                q = nxt[(p + base) * width + c] - base
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(link)
                    nxt.extend(nxt[(q + base) * width:(q + base + 1) * width])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[(p + base) * width + c] == q + base:
                        nxt[(p + base) * width + c] = clone + base
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def _finish(self, codes: list[int], root: int, state: int) -> int:
        """Phrases from ``state`` to the end of one text."""
        table, width, n = self.table, self.letters, 0
        for c in codes:
            to = table[state * width + c]
            if to < 0:
                n += state != root  # a phrase ends before c ...
                to = table[root * width + c]
                if to < 0:  # ... and c, unknown, is one of its own
                    n += 1
                    to = root
            state = to
        return n + (state != root)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of the greedy parse of each text into longest matches: texts x automata.
        The texts are read in step, a letter of each at a time, while many are left."""
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        if not len(self.roots):
            return out
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        codes = self.coded("".join(texts[i] for i in order))
        size = size[order]
        at = np.cumsum(size) - size
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(texts), axis=1)
        n = np.zeros(state.shape, np.int64)
        first = self.steps[roots * self.letters + np.arange(self.letters)]  # automata x letters: steps from the roots
        left, t = len(texts), 0
        while True:
            while left and size[left - 1] <= t:
                left -= 1
            if left < IN_STEP:
                break
            c = codes[at[:left] + t].astype(np.int64)
            now = state[:, :left]
            to = self.steps[now * self.letters + c]
            a, d = np.nonzero(to < 0)
            if len(a):
                again = first[a, c[d]]
                n[a, d] += (now[a, d] != roots[a, 0]).astype(np.int64) + (again < 0)
                to[a, d] = np.where(again < 0, roots[a, 0], again)
            state[:, :left] = to
            t += 1
        ended = np.arange(len(texts)) >= left
        n[:, ended] += (state != roots)[:, ended]
        for i in range(left):
            rest = codes[at[i] + t:at[i] + size[i]].tolist()
            for k, root in enumerate(self.roots):
                n[k, i] += self._finish(rest, root, int(state[k, i]))
        out[order] = n.T
        return out


def prepared(text: str, cut) -> str:
    """The letters of a text, case-folded, with one space for all else between them and at
    the ends; empty if it has no letter."""
    words = cut(text.lower())
    return f" {' '.join(words)} " if words else ""


def training_texts(docs: DataFrame, usable: Column, rows: int = 24, languages: int = 64, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Labelled texts: of each of at most ``languages`` labels at most ``rows`` rows."""
    known = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"))
    most = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    # hashes below a bound that leaves about four times the rows of each language, so
    # that only those are ranked
    below = {k: min(1.0, (4 * rows + 100) / n) for k, n in counts.items()}
    if not below:
        return {}
    bound = F.create_map(*[F.lit(x) for k, share in below.items() for x in (k, int((share - 0.5) * (2**64 - 2**12)))])
    order = Window.partitionBy("lang").orderBy("h", "id")
    ids = ids.filter(F.col("h") <= bound[F.col("lang")]).distinct().withColumn(
        "n", F.row_number().over(order)).filter(F.col("n") <= rows).select("id", "lang")
    # at most ``rows`` ids per language
    texts = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(
        F.broadcast(ids), ["id", "lang"], "left_semi").distinct()
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect()):
        out.setdefault(r["lang"], []).append(r["t"])
    return out


class Model:
    """Automata of the languages."""

    def __init__(self, texts: dict[str, list[str]]):
        import regex

        self.cut = regex.compile(r"\p{L}+").findall
        self.langs = sorted(texts)
        self.automata = SuffixAutomaton(["".join(prepared(t, self.cut) for t in texts[k]) for k in self.langs])
        self.weight = np.log2(np.maximum(self.automata.size, 2))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases per character of that language) of each text."""
        clean = [prepared(t, self.cut) if t and self.langs else "" for t in texts]
        out = [(UNKNOWN, 0.0, 1.0)] * len(texts)
        known = [i for i, t in enumerate(clean) if t]
        counts = self.automata.phrases([clean[i] for i in known])
        for i, phrases in zip(known, counts, strict=True):
            entropy = phrases * self.weight / len(clean[i])
            order = np.argsort(entropy, kind="stable")
            best = int(order[0])
            score = 1.0 - entropy[best] / entropy[order[1]] if len(order) > 1 else 1.0
            out[i] = self.langs[best], float(score), float(phrases[best] / len(clean[i]))
        return out


def in_hand(texts: pa.Array, rows: int = IN_HAND, size: int = BYTES_IN_HAND) -> Iterator[pa.Array]:
    """The texts in slices of at most ``rows`` texts and, if more than one, ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = min(max(int(np.searchsorted(ends, before + size, "right")), i + 1), i + rows)
        yield texts[i:j]
        i = j


def predict(docs: DataFrame, labelled: dict[str, list[str]], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (by default all that aren't named as a result)
    with ``__lang``, ``__score`` and ``__rate`` (phrases per character)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(labelled), uuid.uuid4().hex
    carry = [c for c in docs.columns if c not in ("__lang", "__score", "__rate")] if carry is None else carry
    rows, (text, *kept) = own_names(docs, text_col, *carry)
    sent = kept if text in kept else [*kept, text]  # a text that is carried isn't sent twice
    place = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_state(("langid", name), lambda: Model(shared.value))
        for b in batches:
            found: list[tuple] = []
            for part in in_hand(b.column(place)):
                found += model.predict(part.to_pylist())
            lang, score, rate = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                names=[*carry, "__lang", "__score", "__rate"])

    schema = T.StructType([docs.schema[c] for c in carry]).add("__lang", "string").add("__score", "double").add(
        "__rate", "double")
    return rows.select(*sent).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def keep_identified(docs: DataFrame, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The documents in one of the languages learned from the held-in rows: those whose
    best parse needs at most ``most`` phrases per character, with their own columns.
    Without any labelled row nothing can be judged and all documents stay."""
    labelled = training_texts(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not labelled:
        return docs
    rows, (text,) = own_names(docs, text_col)
    out = predict(rows, labelled, text).filter((F.col("__lang") != UNKNOWN) & (F.col("__rate") <= most))
    return out.select(*rows.columns).toDF(*docs.columns)
