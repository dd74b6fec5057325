"""DuckDB SQL of the numbered operators that SQL can express.  Constants are written
out here, not imported from the operators."""

from __future__ import annotations

OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
cov AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(w) AS x FROM d),
stops AS (
  SELECT doc_id, count(*) AS n FROM wd WHERE lower(x) IN (
    'the', 'of', 'and', 'to', 'in', 'is', 'that', 'was', 'for', 'on', 'with', 'be', 'this', 'are',
    'der', 'die', 'und', 'das', 'den', 'nicht', 'von', 'zu', 'sich', 'mit', 'dem', 'ein', 'auf',
    'le', 'la', 'les', 'et', 'des', 'un', 'une', 'est', 'que', 'pour', 'dans', 'pas', 'au', 'de',
    'el', 'y', 'los', 'las', 'se', 'del', 'por', 'con', 'una', 'su', 'para', 'al', 'lo', 'como')
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(stops.n, 0) AS n_stop
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN stops USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
       AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop >= 1 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM b
"""

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT page_id, h, n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 12), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
rep AS (SELECT doc_id, s, doc_id > min(doc_id) OVER (PARTITION BY h) AS later FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM rep WHERE later),
wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
  FROM wd ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = r"""
WITH RECURSIVE
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
h AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))),
           4294967295) % 20 AS d
  FROM c),
dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE d <> 0),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM dam),
r AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS ini,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au')
                  AND i > 1, false) AS bad,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f
  FROM pos),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
         count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (bad) AS illegal, max(i) AS n
  FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s0,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s2,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s3
  FROM sums
  UNION ALL
  SELECT conv_id, i, CASE WHEN e0 IS NOT NULL THEN {'c': e0.c + 3, 'a': e0.a || 'D', 't': e0.t} END,
    list_min([
      CASE WHEN e1 IS NOT NULL THEN {'c': e1.c + 3, 'a': e1.a || 'D', 't': e1.t} END,
      CASE WHEN f NOT IN (1, 2) AND ini = 's' AND e0 IS NOT NULL THEN {'c': e0.c + x, 'a': e0.a || 'K', 't': e0.t || own} END]),
    list_min([
      CASE WHEN e2 IS NOT NULL THEN {'c': e2.c + 3, 'a': e2.a || 'D', 't': e2.t} END,
      CASE WHEN f NOT IN (1, 2) AND ini = 'u' AND b2 IS NOT NULL THEN {'c': b2.c + x, 'a': b2.a || 'K', 't': b2.t || own} END,
      CASE WHEN f NOT IN (1, 2) AND b2 IS NOT NULL THEN {'c': b2.c + x + 2, 'a': b2.a || 'R', 't': b2.t || chr(10) || 'user:' || text} END]),
    list_min([
      CASE WHEN e3 IS NOT NULL THEN {'c': e3.c + 3, 'a': e3.a || 'D', 't': e3.t} END,
      CASE WHEN f NOT IN (1, 2) AND ini = 'a' AND e2 IS NOT NULL THEN {'c': e2.c + x, 'a': e2.a || 'K', 't': e2.t || own} END,
      CASE WHEN f NOT IN (1, 2) AND e2 IS NOT NULL
           THEN {'c': e2.c + x + 2, 'a': e2.a || 'R', 't': e2.t || chr(10) || 'assistant:' || text} END])
  FROM (
    SELECT *, list_min([e0, e1, e3]) AS b2 FROM (
      SELECT dp.conv_id, r.i, r.f, r.ini, r.text, chr(10) || r.role || ':' || r.text AS own, CASE WHEN r.f = 3 THEN 1 ELSE 0 END AS x,
        s0 AS e0, s1 AS e1,
        list_min([s2,
          CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 2, 'a': s0.a || 'I', 't': s0.t || chr(10) || 'user:'} END,
          CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'} END,
          CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'I', 't': s3.t || chr(10) || 'user:'} END]) AS e2,
        list_min([s3,
          CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 4, 'a': s0.a || 'II', 't': s0.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END,
          CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END,
          CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'} END]) AS e3
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
fin AS (
  SELECT dp.conv_id, list_min([s0, s3,
      CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'} END,
      CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END]) AS e
  FROM dp JOIN sums ON sums.conv_id IS NOT DISTINCT FROM dp.conv_id AND sums.n = dp.i)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
win AS (
  SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d)),
rep AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
new AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens FROM rep),
grp AS (SELECT doc_id, s, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM new),
span AS (SELECT doc_id, g, min(s) AS lo, max(s) + 100 AS hi FROM grp GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prior, lo FROM span),
kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS k, max(hi) AS hi,
         count(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
out AS (
  SELECT d.doc_id, n, coalesce(n_spans, 0) AS n_spans, coalesce(k, '') || substr(x, 2 * coalesce(hi, 0) + 1) AS k
  FROM d LEFT JOIN kept USING (doc_id))
SELECT doc_id, n AS n_bytes, CAST(n - length(k) // 2 AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM out
"""

ORACLES = {"op1_warc": OP1, "op4_substrings": OP4, "op6_quality_rules": OP6, "op8_top_k": OP8,
           "op11_conversation_repair": OP11, "op13_suffix_dedup": OP13}
