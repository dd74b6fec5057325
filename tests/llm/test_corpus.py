"""WARC, dedup, sharding, packing, search and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from platewise.llm import common, mtree, packing, sharding, simhash, substrings, warc

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n=60):
    """Random texts, some with long passages of others, copies, null and empty ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if out and rng.random() < 0.5:
            src = (rng.choice(out) or "").split()
            at = rng.randint(0, len(src))
            w[3:3] = src[at:at + rng.randint(5, 40)]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return [*out, None, "", " \n", out[3], out[3], " ".join(["a"] * 50), " ".join(["a"] * 20)]


# ---- WARC

@pytest.fixture
def pages(spark):
    magic = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(5, "u", "a" * 100), (3, "u", "a" * 100), (9, None, "a" * 100), (4, "u", "b" * 99), (6, "u", "b" * 99),
            (1, "u", None), (2, "u", ""), (7, "u", magic), (8, "u\r\nX: y", magic + "WARC/1."), (10, "u", "WARC/1.1\r\n" * 3000),
            (11, "u", "é\n" * 300), (9, "u", "a" * 100), (12, "u", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "c" * 70000)]
    rows += [(i, "u", f"page {i} " * (i % 40)) for i in range(20, 120)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, payload long")


@pytest.mark.parametrize("split,deal", [("512", 100_000), ("512", 40), ("20000", 100_000), ("128m", 100_000)])
def test_warc_round_trip(spark, pages, monkeypatch, split, deal):
    monkeypatch.setattr(warc, "BROADCAST_SPLITS", deal)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, split)
        path = common.scratch(spark, "test-warc")
        warc.write_warc(pages.coalesce(2), path)
        got = sorted((r.record_id, r.record_type, bytes(r.payload), r.refers_to, r.payload_length, r.payload_digest)
                     for r in warc.read_warc(spark, path).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, h in rows:
        first[h] = min(first.get(h, i), i)
    want = []
    for i, h in rows:
        later = len(h) >= 100 and first[h] < i
        want.append((f"urn:page:{i}", "revisit" if later else "response", b"" if later else h,
                     f"urn:page:{first[h]}" if later else None, len(h), hashlib.sha256(h).hexdigest()))
    assert got == sorted(want)


def test_warc_broken_archives(spark):
    path = common.scratch(spark, "test-warc")
    rec = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    spark.createDataFrame([(rec + rec + rec[:-6],)], "value string").write.text(path)  # the file ends within a record
    spark.createDataFrame([("junk" + rec,)], "value string").coalesce(1).write.mode("append").text(path)
    assert [bytes(r.payload) for r in warc.read_warc(spark, path).collect()] == [b"abc", b"abc"]
    empty = common.scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


# ---- substring dedup

def plain_repeats(rows, length):
    first = {}
    docs = [(i, (t or "").split()) for i, t in rows]
    for i, w in docs:
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in docs:
        gone = {p for s in range(len(w) - length + 1) if first[tuple(w[s:s + length])] < i for p in range(s, s + length)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("seed,length,gram,bits", [(1, 13, 4, 20), (2, 13, 4, 7), (3, 6, 2, 20), (4, 13, 13, 20)])
def test_substrings_brute_force(spark, make, monkeypatch, seed, length, gram, bits):
    rows = list(enumerate(texts(seed)))
    real = substrings.repeats
    monkeypatch.setattr(substrings, "repeats", lambda *a, **k: real(*a, **k, bitmap_bits=bits))
    out = substrings.remove_repeats(make([*rows, (None, rows[3][1])]), length, gram)
    got = {r.doc_id: (r["__n_words"], r["__n_removed"], r["__kept"]) for r in out.collect()}
    none = got.pop(None)
    assert got == plain_repeats(rows, length) and none[1] == 0


def test_substring_stage(make):
    long = " ".join(WORDS[:30])
    docs = make([(1, long), (2, long + " tail"), (3, long), (4, None), (5, ""), (1, long), (6, "x \n y")])
    out = substrings.keep_unrepeated(docs, size_col="n_chars")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [
        (1, long, len(long)), (1, long, len(long)), (2, "tail", 4), (5, "", 0), (6, "x \n y", 5)]
    assert substrings.keep_unrepeated(make([])).count() == 0


# ---- SimHash

def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(fps):
        for j in range(i):
            if (f ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


@pytest.mark.parametrize("k,radius", [(3, 2), (1, 3)])
def test_simhash_brute_force(make, k, radius):
    rows = list(enumerate(["É Ab c", "one two", *texts(7)]))
    out = simhash.near_duplicates(make(rows), k, radius).collect()
    fps = [(i, plain_fingerprint(t, k)) for i, t in rows]
    assert {r.doc_id: r.fp % 2**64 for r in out} == dict(fps)
    assert {r.doc_id: r.component for r in out} == plain_components(fps, radius)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    rng = random.Random(radius)
    for level, free in ((0, (1 << 64) - 1), (1, 0x00FF00FF0F0F3355)):
        bits = [b for b in range(64) if free >> b & 1]
        ms = simhash.masks(radius, free, level)
        for _ in range(500):
            diff = sum(1 << b for b in rng.sample(bits, radius))
            assert any(diff & m == 0 for m in ms)


@pytest.mark.parametrize("bucket", [256, 3])
def test_large_buckets_lose_no_link(spark, bucket):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            values.add(x)
    fps = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    pairs = simhash.links(fps, 2, bucket=bucket)
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 64 for r in pairs.collect())
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    want = plain_components([(simhash._signed(x), x) for x in values], 2)
    groups = {}
    for x in values:
        groups.setdefault(want[simhash._signed(x)], set()).add(roots.get(simhash._signed(x), simhash._signed(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({next(iter(g)) for g in groups.values()})


def test_simhash_stage(make):
    docs = make([(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (7, None), (8, ""), (None, "zz yy xx"), (None, "a b c d")])
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, -1, 2, 7]
    assert simhash.keep_first(make([])).count() == 0


# ---- sharding

def test_minimax_is_least():
    rng = random.Random(6)

    def least(sizes, k):
        if k == 1:
            return sum(sizes)
        return min(max(sum(sizes[:i]), least(sizes[i:], k - 1)) for i in range(len(sizes) + 1))

    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        k = rng.randint(1, 4)
        cap, starts = sharding.minimax_cuts(np.array(sizes), k)
        runs = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
        assert cap == max(runs) == least(sizes, k) and len(starts) <= k and sum(runs) == sum(sizes)


@pytest.mark.parametrize("bits", [16, 3])
def test_sharding_laws(make, bits):
    rows = [*enumerate(texts(8)), (900, "a b c"), (900, "a b c"), (None, "a b c")]
    out = sharding.shard(make(rows), 7, bits).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t in rows} | {None: "a b c"}
    slots, shard_of = {}, {}
    for r in out:
        t = text[r.doc_id]
        assert (r["size"], r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert sharding.shard(make([])).count() == 0


# ---- packing

def plain_best_fit(lengths, capacities, quadratic, fill):
    opens, bins, used, size = packing.opening(capacities, quadratic, fill), [], [], []
    for s in lengths:
        fits = [(size[b] - used[b], b) for b in range(len(used)) if size[b] - used[b] >= s and size[b] > used[b]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(used)
            used.append(0)
            size.append(opens[s])
        bins.append(b)
        used[b] += s
    return bins, [min(c for c in capacities if c >= u) for u in used]


def test_best_fit_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        caps = rng.choice([(8, 16, 32), (5, 7, 50), (10,)])
        lengths = sorted((rng.randint(1, max(caps)) for _ in range(rng.randint(0, 80))), reverse=True)
        bins, _, final = packing.best_fit(lengths, caps, 64.0, 0.9)
        assert (bins, final) == plain_best_fit(lengths, caps, 64.0, 0.9)


def test_packing_laws(make):
    rows = [*enumerate(texts(10)), (500, "x " * 1000), (500, "x " * 1000), (501, None)]
    out = packing.pack(make(rows), capacities=(16, 32, 64), group=16).collect()
    bins, lengths = {}, {}
    for r in out:
        bins.setdefault(r.bin, []).append(r)
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert [r.offset for r in b] == [0, *np.cumsum([r.length for r in b])[:-1].tolist()]
        used = sum(r.length for r in b)
        assert {(r.used, r.capacity) for r in b} == {(used, min(c for c in (16, 32, 64) if c >= used))}
    assert lengths == {i: (len((t or "").split()) + 1) * (2 if i == 500 else 1) for i, t in rows}
    assert packing.pack(make([])).count() == 0


# ---- top-k search

@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    x = (centres[rng.integers(0, 6, 700)] + rng.normal(size=(700, 12)) * 0.1).astype(np.float32)
    x[5] = x[6] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(700, None, 1), (800, [None] + [0.0] * 11, 1), (900, [float("nan")] * 12, 1), (1000, [float("inf")] * 12, 1),
           (1100, [1.0] * 3, 1), (1200, [2.0] * 3, 1), (1300, [], 1), (0, x[0].tolist(), 1), (None, x[0].tolist(), 1)]
    table = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, score int")
    v = mtree.integer_vectors(table)
    out = mtree.search(mtree.index(v, tree=100, leaf=8, fanout=4), v.filter("id % 100 = 0"), 10, block=3)
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = np.floor(1024 * np.vstack([x, x[:1]]).astype(float)).astype(int)
    ids = np.array([*range(700), 0])
    for q in range(0, 700, 100):
        s = vectors @ vectors[q]
        want = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
        assert got.pop(q) == want
    assert got == {1100: [(1200, 3 * 1024 * 2048)], 1200: [(1100, 3 * 1024 * 2048)]}
    none = mtree.integer_vectors(table.limit(0))
    assert mtree.search(mtree.index(none), none).count() == 0


def test_large_components_stay_exact():
    ids = np.arange(3)
    v = np.array([[2**27 + 1, 2**27], [2**27, 2**27 + 3], [5, 7]])
    tree = mtree.Tree(mtree.build(ids, v, leaf=1, fanout=2))
    q = np.array([2**27 + 1, 2**27 - 1])
    assert tree.top(-1, q, 3) == sorted(((int(x @ q), int(i)) for i, x in zip(ids, v)), key=lambda t: (-t[0], t[1]))


# ---- pipeline

def test_pipeline_brute_force(spark, sf001):
    import corpus_pipeline
    from platewise.llm import langid, quality

    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id]]
    left = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id")
    model = langid.Model(langid.training_texts(left, ~langid.held_out()))
    rows = [r for r, p in zip(rows, model.predict([t for _, t in rows])) if p[0] != "und" and p[2] <= 0.5]
    component = plain_components([(i, plain_fingerprint(t, 3)) for i, t in rows], 2)
    rows = [(i, t) for i, t in rows if component[i] == i]
    kept = plain_repeats(rows, 13)
    want = {i: n - gone + 1 for i, (n, gone, _) in kept.items() if n > gone}
    got = {}
    for r in corpus_pipeline.run(spark, sf001).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(got) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "simhash_dedup", "substring_dedup", "packing"]


def test_stages_take_empty_and_odd_documents(spark, make, tmp_path):
    import corpus_pipeline

    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (make([]), make([(1, None), (2, ""), (None, "a b"), (1, None)])):
        docs = docs.select(cols)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.collect()
            assert name == "packing" or out.columns == cols


@pytest.mark.parametrize("name", ["op1_warc", "op4_substrings", "op6_quality_rules", "op8_top_k"])
def test_queries_match_sql(spark, sf001, name):
    import duckdb

    from platewise.llm.oracle import ORACLES
    from platewise.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf001}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in cols]
    df = QUERIES[name](spark, sf001)
    assert sorted(df.columns) == cols
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(
        (tuple(r[i] for i in at) for r in want.fetchall()), key=key)
