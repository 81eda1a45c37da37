"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_BITS = "list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"

#: CRC-32 in SQL: a table of 256 remainders (one row, column tab), then a step for each byte.
CRC_TABLE = f"SELECT list(r ORDER BY i) AS tab FROM (SELECT i, {_BITS} AS r FROM (SELECT unnest(range(256)) AS i))"


def crc32(bytes_: str) -> str:
    """CRC-32 of a list of byte values, where the column of CRC_TABLE is in reach."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({_LOWER.format(t=text)}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


#: SHA-1 as base32: groups of five hexadecimal digits are four letters.
_BASE32 = (
    "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '')"
)

WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM h GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (h)"""

LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
n AS (SELECT a, count(*) AS n FROM pair GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.a = v.vec_id"""

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS t, least(13, len(w)) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
found AS MATERIALIZED (SELECT r, i, s.m AS m, item FROM (SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)) s JOIN win ON win.t = s.t AND win.m = s.m),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM found)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, {words("text")} AS w FROM documents),
rep AS MATERIALIZED (SELECT text, min(doc_id) AS id, any_value(w) AS w FROM d WHERE text <> '' GROUP BY text),
s AS MATERIALIZED (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM rep WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pair AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2) p
  JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE 10 * k >= 8 * (u.n + v.n - k)),
reach(a, b) AS (SELECT id, id FROM rep UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(c, doc_id) AS class_id, doc_id = coalesce(c, doc_id) AS kept FROM d LEFT JOIN rep ON rep.text = d.text LEFT JOIN c ON c.a = rep.id"""


#: Places of equal words at most a quarter of the text apart, as islands by lag; a run within one of a smaller period is not one.
PERIODS = f"""
WITH tab AS ({CRC_TABLE}),
h AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  {crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS h FROM documents, tab),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
x AS MATERIALIZED (SELECT r, n, unnest(w) AS t, unnest(range(n)) AS i FROM d),
isle AS (SELECT r, q, min(i) AS s, count(*) + q AS m FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k
  FROM (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.t = y.t AND y.i > x.i AND y.i <= x.i + x.n // 4)) GROUP BY r, q, k),
long AS MATERIALIZED (SELECT * FROM isle WHERE m >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long o WHERE o.r = l.r AND o.q < l.q AND l.q % o.q = 0 AND o.s <= l.s AND o.s + o.m >= l.s + l.m)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM run),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY i) AS c FROM x ANTI JOIN gone USING (r, i) GROUP BY r),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS l, first({{'s': s, 'm': m, 'q': q}} ORDER BY m DESC, s, q) AS b FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, CAST(b.m AS BIGINT) AS length, b.q AS period, CAST(1000 * b.m // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256 FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    from coppice.llm import importance, licences, line_rules

    return {
        "op2_warc_round_trip": WARC,
        "op4_inverted_multi_index": LINKS,
        "op5_wu_manber_decontamination": DECONTAMINATION,
        "op8_licence_digests": licences.sql(),
        "op9_probminhash_near_dedup": NEAR_DUPLICATES,
        "op11_lag_counting_runs": PERIODS,
        "op12_position_table_resampling": importance.sql(),
        "op13_line_first_cleaning": line_rules.sql(),
    }
