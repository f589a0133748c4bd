"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP4_QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (WHERE regexp_matches(line, '[.!?:;"'')\]][\x20\x09-\x0D]*$')) AS n_ended_lines
  FROM l GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_ended_lines, 0) AS n_ended_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND coalesce(word_chars / nullif(n_words, 0), 0) BETWEEN 2.5 AND 12
         AND coalesce(n_symbols / nullif(n_words, 0), 0) <= 0.2
         AND coalesce(n_stop_words / nullif(n_words, 0), 0) BETWEEN 0.06 AND 0.8
         AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.35
         AND coalesce(n_ended_lines / nullif(n_lines, 0), 0) >= 0.2 AS kept,
       n_lines, n_stop_words, n_ended_lines
FROM b
"""

OP5_MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 12) AS BIGINT) * 4096
           + (row_number() OVER (PARTITION BY doc_id, text) - 1) % 4096 AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s
), o AS (  -- sources in the order in which a growing share per weight reaches their ceiling
  SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS ceiling, row_number() OVER (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source) AS k FROM w
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest,
         CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shared
  FROM o
), f AS (
  SELECT rest, shared FROM r WHERE CAST(rest AS DOUBLE) * weight / shared <= 3 * source_size ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN CAST(f.rest AS DOUBLE) * weight / f.shared > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(f.rest AS DOUBLE) * weight / f.shared END AS target
  FROM o, f
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(least(floor(target / source_size), 3) AS BIGINT) END AS passes FROM t
), c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, d.source,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS BIGINT) AS upto,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.hash) AS BIGINT) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN upto - here + here / CAST(2 AS DOUBLE) <= target - passes * source_size
                             AND target - passes * source_size < source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source
FROM c
"""

OP3_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

#: Ids are taken to be unique and not null here, as in the given tables: the order of lines is that of (id, number).
OP9_LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents
), s AS (
  SELECT doc_id, number, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS words FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (  -- the first line of each set; the others match it
  SELECT words, min((doc_id, number)) AS place, len(words) AS n FROM s GROUP BY words
), w AS (
  SELECT place, n, unnest(words) AS word FROM d
), c AS (
  SELECT word, count(*) AS often FROM w GROUP BY word
), p AS (  -- the rarest words, of which a match must share one
  SELECT place, n, word, row_number() OVER (PARTITION BY place ORDER BY often, word) AS pos FROM w JOIN c USING (word)
  QUALIFY pos <= n - (4 * n + 4) // 5 + 1
), m AS (
  SELECT DISTINCT a.place AS later, b.place AS earlier FROM p a JOIN p b ON a.word = b.word AND b.place < a.place AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), gone AS (
  SELECT DISTINCT later AS place FROM m JOIN d a ON a.place = later JOIN d b ON b.place = earlier
  WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n)
), r AS (
  SELECT s.doc_id, s.number FROM s JOIN d USING (words) WHERE (s.doc_id, s.number) <> d.place OR d.place IN (SELECT place FROM gone)
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed, string_agg(number, ' ' ORDER BY number) AS removed FROM r GROUP BY doc_id) USING (doc_id)
"""

#: DuckDB has no crc32: the bytes are folded over the table of the reflected polynomial 0xEDB88320.
OP11_TARGET_RATES = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), f AS (
  SELECT sale_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 AS fold
  FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL), crc
), l AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item, l.vendor_id AS vendor, coalesce(s.client_id, -1) AS client, s.sold_at AS sold, f.fold,
         count(*) AS n, count(*) FILTER (WHERE flag = 'returned') AS s
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id JOIN f ON f.sale_id = s.sale_id
  WHERE s.sold_at IS NOT NULL GROUP BY ALL
), g AS (
  SELECT l.*, i.kind, v.nation_id AS nation, c.segment
  FROM l LEFT JOIN items i ON i.item_id = l.item LEFT JOIN vendors v ON v.vendor_id = l.vendor LEFT JOIN clients c ON c.client_id = l.client
), h AS (
  SELECT *,
""" + ", ".join(
    f"coalesce(sum({x}) OVER (PARTITION BY {of} ORDER BY sold RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)"
    f" - coalesce(sum({x}) OVER (PARTITION BY {of}, fold ORDER BY sold RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS {name}_{x}"
    for name, of in (("a", "true"), *((c, c) for c in ("kind", "nation", "segment", "item", "vendor", "client")))
    for x in "ns"
) + r"""
  FROM g
), r0 AS (SELECT *, CASE WHEN a_n < 1 THEN 500000 ELSE (1000000 * a_s + 50 * 500000) // (a_n + 50) END AS p FROM h
), r1 AS (SELECT *,
""" + ", ".join(f"CASE WHEN {c}_n < 1 THEN p ELSE (1000000 * {c}_s + 50 * p) // ({c}_n + 50) END AS {c}_p" for c in ("kind", "nation", "segment")) + r"""
  FROM r0)
SELECT sale_id, item AS item_id, vendor AS vendor_id, n AS n_lines, s AS n_returned,
""" + ", ".join(
    f"CAST({c}_n AS BIGINT) AS {c}_n, CAST(CASE WHEN {c}_n < 1 THEN {p}_p ELSE (1000000 * {c}_s + 50 * {p}_p) // ({c}_n + 50) END AS BIGINT) AS {c}_rate"
    for c, p in (("item", "kind"), ("vendor", "nation"), ("client", "segment"))
) + r"""
FROM r1
"""

OP12_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS m
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM i)
), grams AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS gram
  FROM (SELECT d.*, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS p FROM d, (SELECT DISTINCT m FROM windows))
), hits AS (
  SELECT doc_id, item_id, m, p FROM grams JOIN windows USING (m, gram)
), hit_words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS word FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_FLOOR_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _round(k: int) -> str:
    """SQL of a round: the nearest of centroids c<k> for each vector as a<k>, and the next centroids."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT vec_id, v, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i]))) AS BIGINT) AS d FROM vectors, c{k})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
), c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN (
    SELECT c, list({_FLOOR_MEAN} ORDER BY i) AS x FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i)
    GROUP BY c) m USING (c)
)"""


#: Ids are taken to be unique and not null here.
OP13_CENTROIDS = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS x FROM vectors QUALIFY c < 16
), {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""

ORACLES = {
    "op13_centroids": OP13_CENTROIDS,
    "op12_decontamination": OP12_DECONTAMINATION,
    "op11_target_rates": OP11_TARGET_RATES,
    "op9_line_dedup": OP9_LINE_DEDUP,
    "op3_top_k": OP3_TOP_K,
    "op5_mix_sources": OP5_MIX_SOURCES,
    "op4_quality_rules": OP4_QUALITY_RULES,
}
