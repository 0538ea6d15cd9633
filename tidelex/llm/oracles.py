"""DuckDB statements for queries of this folder whose results SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain_words(text: str) -> str:
    """Runs of all but ASCII other than letters and digits, A-Z in lower case."""
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


WARC = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
last AS (SELECT html, max(page_id) AS page FROM p GROUP BY html),
digests AS (SELECT html, page, sha1(html) AS h FROM last)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('{_UPPER}234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id < page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < page THEN page END AS refers_to,
  regexp_replace(url, '[\x00-\x20\x7F]', '%20', 'g') AS target_uri, true AS verified
FROM p JOIN digests USING (html)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_plain_words('text')} AS w FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT x, y FROM shared s JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y
  WHERE 5 * s.n >= 4 * (a.n + b.n - s.n)
  UNION ALL
  SELECT a.r, b.r FROM d a JOIN d b ON len(a.w) = 0 AND len(b.w) = 0 AND a.r <> b.r),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
classes AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, class_id, coalesce(l.n, 0) AS n_links, coalesce(s.n, 0) AS n_grams
FROM d JOIN classes ON x = d.r LEFT JOIN sizes s ON s.r = d.r
LEFT JOIN (SELECT x AS r, count(*) AS n FROM links GROUP BY x) l ON l.r = d.r"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_plain_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_plain_words('text')} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
windows AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT d.*, size FROM d, (SELECT DISTINCT size FROM items) s WHERE len(w) >= size),
    unnest(range(1, len(w) - size + 2)) AS t(i)),
hits AS (SELECT r, i, size, item_id FROM windows JOIN items USING (size, words)),
places AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""

WORD_PASSAGES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
later AS (SELECT r, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY words)),
cut AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM later)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM words ANTI JOIN cut USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

#: Bytes as pairs of hexadecimal digits.
BYTE_PASSAGES = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS k
  FROM d, unnest(range(0, strlen(h) // 2 - 399)) AS t(i) WHERE strlen(h) >= 800),
again AS (SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
runs AS (
  SELECT r, min(i) AS first, max(i) + 400 AS last
  FROM (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM (
    SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM again))
  GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(last) OVER per, 0) AS a, first AS b FROM runs WINDOW per AS (PARTITION BY r ORDER BY first)
  UNION ALL SELECT r, max(last), NULL FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (b - a)) END, ''
    ORDER BY a) AS kept FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(last - first) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)"""
