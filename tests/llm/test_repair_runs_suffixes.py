"""Conversation repair, periodic runs and suffix dedup against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import conversation, periodic, queries, suffixes

SPACE = " \t\n\x0b\x0c\r"

# ---- conversations


def plain_edits(roles, faults):
    """Cheapest, then ASCII-least (cost, audit) by trying every edit at every row."""
    best = {0: (0, "")}

    def better(to, state, x):
        if state not in to or x < to[state]:
            to[state] = x

    def insertions(at):
        out = dict(at)
        for _ in range(3):
            for s, (c, a) in list(out.items()):
                better(out, 3 if s == 2 else 2, (c + 2, a + "I"))
        return out

    for role, fault in zip(roles, faults, strict=True):
        nxt = {}
        for s, (c, a) in insertions(best).items():
            better(nxt, s, (c + 3, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            extra, due = int(fault == "truncated"), "a" if s == 2 else "u"
            if role[:1] == "s" and s == 0:
                better(nxt, 1, (c + extra, a + "K"))
            if role[:1] == due:
                better(nxt, 3 if due == "a" else 2, (c + extra, a + "K"))
            better(nxt, 3 if due == "a" else 2, (c + 2 + extra, a + "R"))
        best = nxt
    done = insertions(best)
    return min(done[s] for s in (0, 3) if s in done)


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repaired(rows, audit):
    at, state, out = iter(rows), 0, []
    for e in audit:
        if e == "I":
            state = 3 if state == 2 else 2
            out.append(("assistant" if state == 3 else "user", ""))
            continue
        role, text = next(at)
        if e == "D":
            continue
        state = 1 if e == "K" and role[:1] == "s" else 3 if state == 2 else 2
        out.append((role if e == "K" else "assistant" if state == 3 else "user", text))
    return out


def plain_conversation(rows):
    """All result columns for the rows (turn, role, text) of one conversation, in order."""
    said = [(r, t) for _, r, t in rows]
    faults, roles = plain_faults(said), [r for r, _ in said]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = plain_edits(roles, faults)
    fixed = plain_repaired(said, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def test_hirschberg_equals_plain_search():
    rng, chain = random.Random(5), conversation.Chain()
    for n in [*range(9)] * 60 + [40, 200]:
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(n))
        roles = ["sua?"[c & 3] if c < 8 else "u" for c in codes]
        faults = ["blank" if c == 8 else "truncated" if c & 4 else "" for c in codes]
        want = plain_edits(roles, faults)
        assert chain.repair(codes) == want
        cuts = sorted(rng.randint(0, n) for _ in range(rng.randint(1, 4)))
        blocks = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, n]) if b > a]
        if blocks:
            cost, states = conversation.cross_blocks([chain.table(b) for b in blocks])
            audit = "".join(chain.solve(b, s, e) for b, s, e in zip(blocks, states, states[1:], strict=False))
            assert (cost, audit + conversation.TAIL[states[-1]][1]) == want


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def conversations(seed=0):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([0, 1, 3, 8, 30])):
            if rng.random() < 0.1:
                continue
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]),
                         rng.choice([None, "", " \n", "yes.", "no?", "end", "odd \x0b", "é!\n", f"text {turn}. "])))
    rows += [(100, None, "user", "a."), (100, 5, "assistant", "a."), (101, None, None, None), (102, 3, "user", "x"), (102, 3, "user", "x")]
    rows += [(200, t, "user" if t % 2 else "assistant", f"hot {t % 50}.") for t in range(3000)]  # one long conversation
    return rows


def check_conversations(spark, rows, block):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumns({"conv": F.lit(1), "audit": F.lit("x"), "kind": F.lit(9), "part": F.lit(2)})
    cut = queries.damaged_conversations(df)
    found = conversation.audits(cut, block=block).cache()
    sha = {r.conv: r.sha256 for r in conversation.digests(cut, found).collect()}
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv]) for r in found.collect()}
    want = {c: plain_conversation(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for c, r in damaged(rows).items() if r}
    assert got == want
    fixed = {}
    for r in conversation.repaired(cut, found).orderBy("conv", "pos").collect():
        fixed.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for c, w in want.items():
        assert hashlib.sha256("\n".join(fixed.get(c, [])).encode()).hexdigest() == w[-1]


@pytest.mark.parametrize("block", [65_536, 7])
def test_conversation_repair(spark, block):
    check_conversations(spark, conversations(block), block)


def test_conversation_query(spark, tmp_path):
    rows = conversations(3)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: plain_conversation(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) if r else none
            for c, r in damaged(rows).items()}
    assert got == want


def test_conversations_empty(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    found = conversation.audits(df)
    assert found.count() == 0
    assert conversation.digests(df, found).count() == 0


# ---- periodic runs

def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(
                    all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic_words(rng):
    w = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.5:
            w += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        else:
            p = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31]))]
            w += (p * 40)[:rng.randint(len(p), 5 * len(p) + 20)]
    return w


def test_mismatches_are_exact():
    t, rng = periodic.Transforms(), np.random.default_rng(0)
    for size in (8, 16, 64, 256):
        b, w = (rng.integers(0, 1000, (4, n)).astype(np.uint64) for n in (size, 2 * size))
        want = [[int(((x.astype(int) - y[d:d + size].astype(int)) ** 2).sum()) % periodic.P for d in range(size + 1)]
                for x, y in zip(b, w, strict=True)]
        assert periodic._mismatches(t, b, w).tolist() == want


def test_find_runs_equals_plain_search():
    rng, t = random.Random(1), periodic.Transforms()
    for _ in range(60):
        docs = [periodic_words(rng) for _ in range(6)]
        got = periodic.find_runs([[x.encode() for x in w] for w in docs], t)
        assert got == [plain_runs(w) for w in docs]


def test_long_text_of_one_word():
    t = periodic.Transforms()
    assert periodic.find_runs([[b"x"] * 30_000, [], [b"y"] * 23], t) == [[(0, 30_000, 1)], [], []]


def test_periodic_query(spark, make, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(periodic_words(rng))) for i in range(80)] + [(500, None), (501, ""), (502, " \n"), (3, "a b a b"), (3, "a b a b")]
    rows += [(i, " ".join(f"w{k}" for k in range(200))) for i in range(600, 640)]
    make(rows).select("doc_id", "text", "n_words", "h").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    want = []
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in
               ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(plain_collapsed(w, runs)))]
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    assert got == sorted(want)
    assert sum(x[1] for x in want) > 40


def test_periodic_empty(spark, make):
    assert periodic.periodic_runs(make([])).count() == 0


# ---- suffix dedup

def plain_suffix_dedup(rows, length):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s:s + length], (i, s)) != (i, s):
                gone[s:s + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y))
    return out


def repeating_texts(seed, n, alphabet, longest):
    rng, out = random.Random(seed), []
    for _ in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        for _ in range(rng.randint(0, 3)):
            if out:
                s = rng.choice(out)
                a, at = rng.randint(0, len(s)), rng.randint(0, len(t))
                t = t[:at] + s[a:a + rng.randint(0, longest // 2)] + t[at:]
        out.append(t + (rng.choice(alphabet) * rng.randint(0, 60) if rng.random() < 0.2 else ""))
    return [*out, out[3], out[3], None, ""]


@pytest.mark.parametrize(("length", "alphabet", "longest", "piece", "batches"), [
    (10, "abcdé", 60, 2 << 20, 4), (100, "abcdefgh é", 700, 2 << 20, 4), (100, "abcdefgh é", 900, 300, 3), (24, "ab", 80, 2 << 20, 1)])
def test_suffix_dedup(spark, make, length, alphabet, longest, piece, batches):
    rows = [(3 * i + 1, t) for i, t in enumerate(repeating_texts(length + piece, 50, alphabet, longest))]
    random.Random(1).shuffle(rows)
    docs = make([*rows, (None, "z" * 300)])
    out = suffixes.remove_repeats(docs, length=length, batches=batches, bitmap_bits=16, piece=piece, carry=["doc_id", "h", "kept"]).collect()
    got = {r.doc_id: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in out}
    assert got.pop(None) == (300, 0, 0, b"z" * 300)
    assert got == plain_suffix_dedup(rows, length)
    assert sum(x[1] for x in got.values()) > 500


def test_suffix_family_levels(spark, make):
    docs = make([(i, t) for i, t in enumerate(repeating_texts(2, 40, "abcd", 300))])
    family = suffixes.SuffixFamily()
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("k"), F.col("text").cast("binary").alias("t"))
    every = spark.sparkContext.broadcast(np.full(1, -1, np.int64).tobytes())
    for i in range(7):
        rows = texts.filter(F.col("id") % 7 == i).mapInArrow(
            suffixes._scan(100, "runs", [every], 1 << 20), f"id long, {suffixes.ROWS}")
        family.add(rows)
    assert [n for n, _ in family.levels] == [4, 2, 1]
    found = family.suffixes().select("h", "ext")
    assert found.count() == found.distinct().count()


def test_suffix_dedup_empty_and_ties(spark, make):
    assert suffixes.remove_repeats(make([])).count() == 0
    same = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    out = suffixes.remove_repeats(make([(1, same), (1, same), (2, same)])).collect()
    assert sorted((r.doc_id, r["__n_removed"]) for r in out) == [(1, 0), (1, 0), (2, len(same))]


# ---- columns of earlier queries, recomputed apart from the library

def test_bpe_query_hashes(spark, make, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(x): int(n) for x, n in (line.split() for line in open(path, "rb") if line.strip())}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "the cat\n sat"), (2, None), (3, ""), (4, "ünï 你好 \U0001F600 <|endoftext|>"), (5, "a" * 3000), (5, "b")]
    make(rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op2_bpe(spark, str(tmp_path)).collect()) == sorted(want)


def test_packing_as_a_whole(spark, make):
    """Every group packed again by trying all open bins; every piece placed once."""
    from platewise.llm import packing

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 200, 700, 5000, 9000]))) for i in range(120)] + [(7, None)]
    caps = (64, 128, 512)
    out = packing.pack(make(rows), capacities=caps, group=16).collect()
    pieces = sorted((r.doc_id, r.start, r.length) for r in out)
    want = []
    for i, t in rows:
        n = len((t or "").split()) + 1
        want += [(i, s, min(512, n - s)) for s in range(0, n, 512)]
    assert pieces == sorted(want)
    opens = packing.opening(caps, 8192.0, 0.95)
    groups = {}
    for r in out:
        groups.setdefault(r.bin >> 32, []).append(r)
    assert len(groups) > 4
    for rows_of in groups.values():
        bins = []  # room, used, capacity opened
        placed = {}
        for r in sorted(rows_of, key=lambda r: (-r.length, r.doc_id, r.piece)):
            fits = [(room, b) for b, (room, _, _) in enumerate(bins) if room >= r.length]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append((opens[r.length], 0, opens[r.length]))
            room, used, cap = bins[b]
            placed.setdefault(b, []).append((r.length, used))
            bins[b] = (room - r.length, used + r.length, cap)
        got = {}
        for r in rows_of:
            got.setdefault(r.bin, []).append((r.length, r.offset))
            assert r.capacity == min(c for c in caps if c >= r.used) and r.used == sum(x.length for x in rows_of if x.bin == r.bin)
        assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in placed.values())


def test_sharding_as_a_whole(spark, make):
    """The largest shard is the least possible over the ordered atoms; groups stay whole."""
    from platewise.llm import sharding

    rng = random.Random(6)
    rows = [(i, rng.choice(["same", "x" * rng.randint(0, 400), None])) for i in range(300)]
    out = sharding.shard(make(rows), shards=7).collect()
    assert len(out) == 300
    atoms, shards, texts = {}, {}, {}
    by_id = dict(rows)
    for r in out:
        atoms[r.atom] = atoms.get(r.atom, 0) + r["size"]
        shards.setdefault(r.shard, []).append(r)
        texts.setdefault(by_id[r.doc_id] or "", set()).add(r.shard)
        assert (r["size"], r.text_crc32) == (len((by_id[r.doc_id] or "").encode()) + 16, zlib.crc32((by_id[r.doc_id] or "").encode()))
    assert all(len(x) == 1 for x in texts.values())
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in shards.values())
    sizes = [n for _, n in sorted(atoms.items())]
    best = [[0] + [10**9] * len(sizes)]  # least largest part of the first j atoms in k parts
    for _ in range(7):
        last = best[-1]
        best.append([0] + [min(max(last[i], sum(sizes[i:j])) for i in range(j)) for j in range(1, len(sizes) + 1)])
    assert max(sum(r["size"] for r in rs) for rs in shards.values()) == min(b[-1] for b in best)
