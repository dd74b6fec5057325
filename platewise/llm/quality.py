"""Quality rules: a threshold table compiled into one Spark projection.

Each rule is a row (name, numerator, denominator, least percent, most percent) over
counts of the text; the table is compiled into one boolean column, so a scan evaluates
every rule in one pass, JVM-side, without user functions and without a shuffle.

Counts (a null text counts as empty; lines are cut at ``\\n``; words are runs without
the six ASCII white-space characters):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (``#*$%&|<>``)
* ``n_lines`` (lines that have a word), ``n_dup_lines`` (those equal to an earlier one)
* ``n_stop_words`` (words, lower-cased, in ``STOP_WORDS``)
* ``n_repeat_words`` (words in 3-word windows found at least twice in the text)

``n_repeat_words`` hashes the windows with 64-bit XXH64; only texts in which a hash
repeats sort their (hash, position) pairs, and the covered positions are summed in one
fold.  All work is inside a row: cost grows with the text, nothing is grouped.

Defined results: null or empty text -> all counts 0, ``base_failed`` true, not kept.
Equal rows get equal verdicts, an empty table gives an empty result.  A rule whose
denominator is 0 passes.  Input columns never clash: all counts live in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import own_names, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages the corpora hold (lower case).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "was", "for", "on", "with", "be", "this", "are",
    "der", "die", "und", "das", "den", "nicht", "von", "zu", "sich", "mit", "dem", "ein", "auf",
    "le", "la", "les", "et", "des", "un", "une", "est", "que", "pour", "dans", "pas", "au", "de",
    "el", "y", "los", "las", "se", "del", "por", "con", "una", "su", "para", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """Passes when ``least <= 100 * numerator / denominator <= most`` (None: open)."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", most=10),
    Rule("stop_words_per_word", "n_stop_words", "n_words", least=1),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", most=50),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words covered by a 3-word window that occurs at least twice in the text."""
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = _let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: _twin(s, x, j)), lambda x: x["i"])))
        return F.aggregate(
            starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(covered(h)))


def _twin(s: Column, x: Column, j: Column) -> Column:
    """Whether a neighbour in the sorted pairs has the same hash."""
    return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | \
        F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))


def with_counts(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``text_col`` in the struct column ``out``."""
    w, t, lines = f"{out}_words", f"{out}_text", f"{out}_lines"
    text = F.coalesce(F.col(text_col), F.lit(""))
    prepared = docs.withColumns({
        t: text,
        w: words(F.col(text_col)),
        lines: F.filter(F.split(text, "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]"))})
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeat_words(F.col(w)).alias("n_repeat_words"))
    return prepared.withColumn(out, counts).drop(w, t, lines)


def base_failed(counts: Column) -> Column:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def compile_rules(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean: every rule of the table passes."""
    verdict = F.lit(True)
    for r in rules:
        num, den = 100 * counts[r.numerator], counts[r.denominator]
        if r.least is not None:
            verdict = verdict & ((den == 0) | (num >= r.least * den))
        if r.most is not None:
            verdict = verdict & ((den == 0) | (num <= r.most * den))
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts, base verdict and ``kept``."""
    m = F.col("__q")
    return with_counts(docs.select(id_col, text_col), "__q", text_col).select(
        id_col, "__q.*", base_failed(m).alias("base_failed"),
        (~base_failed(m) & compile_rules(m, rules)).alias("kept"))


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns.

    The row number takes part in the condition (it is never negative) so that the
    optimizer leaves the filter above the counts: below them it would compute the words
    anew for each use, inside lambdas once for each word."""
    m = F.col("__q")
    rows, (text,) = own_names(docs, text_col)
    counted = with_counts(rows, "__q", text).withColumn("__row", F.monotonically_increasing_id())
    return counted.filter(~base_failed(m) & compile_rules(m, rules) & (F.col("__row") >= 0)).select(
        *rows.columns).toDF(*docs.columns)
