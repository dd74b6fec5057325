"""Quality rules, tokenizers and language ID against plain re-computations."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from platewise.llm import bpe, langid, quality, tokencount

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n\t", "a", "the the the the", "x" * 5000, "a b " * 4000, "café ß 你好 \U0001F600",
       "a b c", "<|endoftext|>a<|endoftext|>", "\x1c\x1f \x85", "l\nl\nl\n m\n", "12 345,6 don't  x",
       "՘֋ b1", "#$ | <> **"]


def rows_of(texts):
    return [*enumerate(texts), (0, texts[0]), (None, "no id")]


def plain_quality(text):
    w = [x for x in re.split(r"[ \x09-\x0D]+", text or "") if x]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    covered = {i + k for i, t in enumerate(tri) if seen[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(make):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("ab cd the of x# yy".split()) for _ in range(rng.randint(0, 90)))
                   + rng.choice(["", "\n"]) for _ in range(60)]
    out = quality.quality(make(rows_of(texts))).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        n, chars, symbols, dup, rep = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), text
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_stage_keeps_columns(make):
    good = " ".join(f"the word{i} of line{i}" for i in range(30))
    docs = make([(1, good), (2, "short"), (3, None), (4, "a$$ " * 60), (5, good), (None, good)])
    out = quality.keep_quality(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 5]
    assert quality.keep_quality(make([])).count() == 0


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(make, library):
    docs = make(rows_of(ODD))
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256(text.encode()).digest()
    assert bpe.encode(make([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_any_bytes(library):
    ranks, rng = bpe.load_ranks(RANKS), random.Random(2)
    for n in [*range(1, 40), 3000]:
        piece = bytes(rng.choice(b"aaenth \xc3\xa9\xff") for _ in range(n))
        assert bpe.merge(piece, ranks) == library._core_bpe.encode_single_piece(piece)


def test_token_counts_equal_library(make):
    tok = Tokenizer.from_file(JSON)
    for entries in (1, 100):  # both tiers, and the library
        out = tokencount.count_tokens(make(rows_of(ODD)), JSON, public_tokenizers.PATTERN, entries=entries, fit_rows=5).collect()
        assert len(out) == len(ODD) + 2
        for r in out:
            text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids)), text
    assert tokencount.count_tokens(make([]), JSON, public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_tables(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    tok = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, JSON, public_tokenizers.PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in rows}


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        n, i = 0, 0
        while i < len(s):
            k = 0
            while i + k < len(s) and s[i:i + k + 1] in text:
                k += 1
            n, i = n + 1, i + max(k, 1)
        assert langid.SuffixAutomaton([text]).phrases([s]).tolist() == [[n]], (text, s)


def test_language_edge_cases(make):
    rows = [(i, "the cat sat on the mat with that hat", "en") for i in range(20)]
    rows += [(i, "der hund und die katze nicht ohne das haus", "de") for i in range(20, 40)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 34 !?", "en"), (103, "² Ⅷ", "en"), (104, "hund " * 9000, None)]
    docs = make([*rows, *odd])
    labelled = langid.training_texts(docs, ~langid.held_out())
    assert set(labelled) == {"en", "de"} and all(len(x) <= 24 for x in labelled.values())
    got = {r.doc_id: r for r in langid.predict(docs, labelled).collect()}
    assert [got[i]["__lang"] for i in (0, 25, 104)] == ["en", "de", "de"]
    assert all(got[i]["__lang"] == "und" and got[i]["__score"] == 0 for i in (100, 101, 102))
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    assert {r["__lang"] for r in langid.predict(make(odd), {}, carry=["doc_id"]).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(40), 104}
    assert langid.keep_identified(make([])).count() == 0


def plain_phrases(text, s):
    n = i = 0
    while i < len(s):
        k = 1
        while i + k < len(s) and s[i:i + k + 1] in text:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_cross_words():
    m = langid.Model({"de": ["Der Hund ist da.", "hund, katze"], "en": ["a dog"]})
    assert m.automata.phrases([langid.prepared("der HUND-ist da", m.cut)])[0, 0] == 1


def test_parse_in_step_equals_one_by_one():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcä ") for _ in range(n)) for n in (60, 35, 0)]
    many = ["".join(rng.choice("abcäx ") for _ in range(rng.choice([0, 1, 7, 50, 300]))) for _ in range(70)]
    a = langid.SuffixAutomaton(texts)
    together = a.phrases(many)
    assert together.tolist() == [[plain_phrases(t, s) for t in texts] for s in many]


def test_language_query_equals_plain_parse(spark, sf001):
    """Language and score of every document, recomputed by longest matches found with ``in``;
    ties and repeated rows included."""
    import math

    from platewise.llm.queries import op10_language_id

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labelled = langid.training_texts(docs, ~langid.held_out(), rows=3)
    cut = langid.Model({}).cut

    def clean(t):
        return langid.prepared(t, cut)

    texts = {k: "".join(clean(t) for t in v) for k, v in sorted(labelled.items())}
    rows = [r for r in docs.collect() if len(r.text or "") < 1500][:60]
    again = spark.createDataFrame([*rows, *rows[:5]], docs.schema)
    got = [(r.doc_id, r["__lang"], round(r["__score"], 9)) for r in langid.predict(again, labelled, carry=["doc_id"]).collect()]
    want = []
    for r in [*rows, *rows[:5]]:
        t = clean(r.text or "")
        if not t:
            want.append((r.doc_id, "und", 0.0))
            continue
        e = sorted((plain_phrases(x, t) * math.log2(len(x)) / len(t), k) for k, x in texts.items())
        want.append((r.doc_id, e[0][1], round(1 - e[0][0] / e[1][0], 9)))
    assert sorted(got) == sorted(want)
    out = op10_language_id(spark, sf001).collect()
    assert len(out) == docs.count() and {r.lang_pred for r in out} <= {"und", *labelled}


def test_language_ties_and_clashing_names(make):
    docs = make([(1, "abc"), (1, "abc"), (2, "xyz"), (3, None)]).withColumnRenamed("h", "__t")
    out = langid.predict(docs, {"b": ["abc def"], "a": ["abc def"]}).collect()
    assert sorted((r.doc_id, r["__lang"], r["__score"]) for r in out) == [(1, "a", 0.0), (1, "a", 0.0), (2, "a", 0.0), (3, "und", 0.0)]
    assert langid.predict(make([]), {"a": ["x"]}).count() == 0


def test_language_held_out_accuracy(spark, sf001):
    from platewise.llm.queries import op10_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    out = [r for r in op10_language_id(spark, sf001).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out) > 0


def test_automata_are_built_in_little_more_than_their_table():
    import tracemalloc

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=6000)) for _ in range(4)]
    tracemalloc.start()
    a = langid.SuffixAutomaton(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * 4 * len(a.table) + 2_000_000, (peak, 4 * len(a.table))
    apart = np.concatenate([langid.SuffixAutomaton([t]).phrases(texts) for t in texts], axis=1)
    assert (a.phrases(texts) == apart).all()


def test_texts_in_hand_are_bounded_by_bytes():
    texts = pa.array(["a" * n if n else None for n in (5, 0, 3, 20, 1, 1, 1, 4)])
    parts = [p.to_pylist() for p in langid.in_hand(texts, rows=3, size=8)]
    assert sum(parts, []) == texts.to_pylist()
    assert [[len(t or "") for t in p] for p in parts] == [[5, 0, 3], [20], [1, 1, 1], [4]]
    assert list(langid.in_hand(pa.array([], pa.string()))) == []


def test_a_carried_text_is_sent_once(make):
    docs = make([(1, "der hund ist da", "de"), (2, "a dog is here", "en"), (3, None, "en")])
    labelled = {"de": ["der hund ist da"], "en": ["a dog is here"]}
    out = langid.predict(docs, labelled)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "Project" in line)
    assert sent.count("text") == 1, plan
    assert [(r.doc_id, r.text, r["__lang"]) for r in out.orderBy("doc_id").collect()] == [
        (1, "der hund ist da", "de"), (2, "a dog is here", "en"), (3, None, "und")]
    assert [(r.doc_id, r["__lang"]) for r in langid.predict(docs, labelled, carry=["doc_id"]).orderBy("doc_id").collect()] == [
        (1, "de"), (2, "en"), (3, "und")]
