"""SQL twins, for DuckDB, of the queries whose contracts SQL can express on whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

#: op1: shingle sets, pairs by shared shingles, components by recursion.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 85 * (a.n + b.n - both_)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: op3: 100-byte strings as hexadecimal substrings.
REPEATED_BYTES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, CAST(length(x) / 2 AS BIGINT))) AS pos, x FROM h),
b AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 2) AS byte, CASE WHEN 2 * (pos + 100) <= length(x) THEN md5_number(substr(x, 2 * pos + 1, 200)) END AS win FROM p),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS repeats FROM b),
g AS (SELECT *, coalesce(bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g),
o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (NOT gone), ''))) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

#: op4: 13-word windows as strings.
REPEATED_WORDS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, words FROM w),
b AS (SELECT doc_id, pos, words[pos] AS word, CASE WHEN pos + 12 <= len(words) THEN array_to_string(words[pos:pos + 12], ' ') END AS win FROM p),
f AS (SELECT *, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS repeats FROM b),
g AS (SELECT *, bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

#: op6: base32 from the hexadecimal digest, four characters for each five digits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hex,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM p),
m AS (SELECT hex, min(page_id) AS first_ FROM d GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_ THEN first_ END AS refers_to FROM d JOIN m USING (hex)"""
