"""DuckDB SQL of the queries of this subpackage that SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % _FOLD

DECONTAMINATION = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, least(13, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT DISTINCT r, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

HOST_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, list_slice(ws, i, i + 2) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w),
p AS (SELECT r, count(DISTINCT k) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n_repeat, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN p USING (r)),
a AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
b AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines AS rule_failed FROM a),
s AS (SELECT source, count(*) AS n, count(*) FILTER (rule_failed) AS bad FROM b GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) AS spread, avg(1 / n) AS small FROM s),
k AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - small * mean * (1 - mean), 1e-6) - 1, 1), 1000) AS weight FROM m),
q AS (SELECT source, n, weight, mean, (bad + mean * weight) / (n + weight) AS rate FROM s, k),
u AS (SELECT source, mean, rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) AS sure FROM q),
v AS (SELECT source, sure > 0.5 AS rejected, sure > 1.5 * mean AS suspect FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected OR suspect AND rule_failed) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

# A base32 digit for each 5 of the digest's 160 bits: four for each five hexadecimal digits.
WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha, 1 + 5 * i::INTEGER, 5))::BIGINT) AS xs FROM p),
e AS (SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(flatten(list_transform(xs, lambda x: list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> s) & 31)::INTEGER, 1)))), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY sha) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM e
"""
