"""SQL twins of the catalogue's queries, for DuckDB."""

from lectern.operators.handoff import COUNTERS
from lectern.sources.markdown_view import ORACLE_LINES, ORACLE_MD

_WITH_MD = f"WITH {ORACLE_MD} "
_WITH_LN = f"WITH {ORACLE_LINES} "
_NL = "chr(10)"



def _replaced(text: str, pairs: dict[str, str]) -> str:
    """SQL of a text with each of the pairs replaced, in order."""
    for old, new in pairs.items():
        text = f"replace({text}, '{old}', '{new}')"
    return text


#: What the rewrites make of the view's own lines.
_REWRITTEN = {
    "Prior work [1, 2] and [3] and [1]–[3] but": "Prior work [[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]] and [[#^ref-3|³]] and [[#^ref-1|¹]]<sup>,</sup>[[#^ref-2|²]]<sup>,</sup>[[#^ref-3|³]] but",
    "$x_[2]$ of (Doe et al., 2001).": "$x_[2]$ of [[#^ref-2|²]].",
    "over 10 10 trials [2].": "over 10 10 trials [[#^ref-2|²]].",
    "More in [1].": "More in [[#^ref-1|¹]].",
}
_STRUCTURED = {
    "2000.\n\n[2] Doe, J. A study of\nlonger things. arXiv 2001.\n[3] Roe": "2000. ^ref-1\n\n[2] Doe, J. A study of longer things. arXiv 2001. ^ref-2\n\n[3] Roe",
    "\\[cs.LG\\]\n\n## Appendix": "\\[cs.LG\\] ^ref-3\n\n## Appendix",
}
_SUBJECT = {"\\[cs.LG\\]": "[cs.LG]"}
_NAMED = {
    "As \\[doe2001\\] and \\[roe2002, doe2001\\] show.": "As [[#^ref-4|⁴]] and [[#^ref-5|⁵]]<sup>,</sup>[[#^ref-4|⁴]] show.",
    "\\[cs.LG\\]\n\n## Appendix": "\\[cs.LG\\]\n\n[4] Doe. One. 2001 ^ref-4\n\n[5] Roe. Two. 2002 ^ref-5\n\n## Appendix",
}
_PIPES = {"| a | [[#^ref-1|¹]] |": "| a | [[#^ref-1\\|¹]] |"}
_MOVED = {
    "[^1]: J. Doe, A study of things. Journal of X, 2001.\n": "",
    "[^3]: A. Roe, Other things. arXiv, 2003.\n": "",
    "- item two": "- item two[[#^ref-11|¹¹]]",
    "\\[cs.LG\\]\n\n## Appendix": "\\[cs.LG\\]\n\n[11] J. Doe, A study of things. Journal of X, 2001. ^ref-11\n\n[13] A. Roe, Other things. arXiv, 2003. ^ref-13\n\n## Appendix",
}

LINES = _WITH_LN + "SELECT doc_id, line_no, line FROM ln"

#: Regions by counting toggles: frontmatter, fences, display math, HTML tables, references.
_REG = (
    ORACLE_LINES
    + """,
fm AS (SELECT doc_id, CASE WHEN bool_or(line_no = 1 AND trim(line) = '---') THEN min(line_no) FILTER (trim(line) = '---' AND line_no > 1) ELSE 0 END AS fm_end FROM ln GROUP BY doc_id),
r1 AS (SELECT ln.doc_id, line_no, line, line_no <= fm_end AS f, (regexp_matches(line, '^[ \\t]{0,3}```') AND line_no > fm_end) AS tick FROM ln JOIN fm USING (doc_id)),
r2 AS (SELECT *, sum(CASE WHEN tick THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS ticks FROM r1),
r3 AS (SELECT *, tick OR ticks % 2 = 1 AS c FROM r2),
r4 AS (SELECT *, (NOT f AND NOT c AND trim(line) = '$$') AS dollars FROM r3),
r5 AS (SELECT *, dollars OR sum(CASE WHEN dollars THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS m FROM r4),
r6 AS (SELECT *, sum(CASE WHEN line LIKE '<table%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS opened,
       coalesce(sum(CASE WHEN contains(line, '</table>') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM r5),
r7 AS (SELECT *, NOT f AND NOT c AND NOT m AND (line LIKE '<table%' OR opened > closed) AS t FROM r6),
r8 AS (SELECT *, NOT f AND NOT c AND NOT m AND NOT t AND regexp_matches(line, '^#{1,6}\\s+\\S') AS h FROM r7),
r9 AS (SELECT *, last_value(CASE WHEN h AND regexp_matches(line, '^#{1,2}\\s') THEN CASE WHEN line = '## References' THEN 1 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS ref FROM r8),
reg AS (SELECT *, CASE WHEN f THEN 'F' WHEN c THEN 'C' WHEN m THEN 'M' WHEN t THEN 'T' WHEN coalesce(ref, 0) = 1 THEN 'R' ELSE '.' END AS region FROM r9)
"""
)
_WITH_REG = "WITH " + _REG
REGIONS = _WITH_REG + "SELECT doc_id, line_no, region FROM reg"
SECTIONS = _WITH_REG + "SELECT doc_id, line_no, last_value(CASE WHEN h THEN trim(regexp_replace(line, '^#{1,6}\\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM reg"

_JOIN = f"string_agg(line, {_NL} ORDER BY line_no)"
HEADINGS = (
    _WITH_LN
    + f""", fm AS (SELECT doc_id, CASE WHEN bool_or(line_no = 1 AND line = '---') THEN min(line_no) FILTER (line = '---' AND line_no > 1) ELSE 0 END AS fm_end FROM ln GROUP BY doc_id),
h AS (SELECT ln.*, line_no > fm_end AND regexp_matches(line, '^#\\s+\\S') AS h1, line_no > fm_end AND regexp_matches(lower(line), '^#{{1,6}}\\s+abstract\\s*$') AS abs FROM ln JOIN fm USING (doc_id)),
n AS (SELECT *, sum(CASE WHEN h1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS nth FROM h),
o AS (SELECT doc_id, line_no, CASE WHEN (h1 AND nth > 1) OR (abs AND NOT (h1 AND nth = 1)) THEN '## ' || regexp_replace(line, '^#{{1,6}}\\s+', '') ELSE line END AS line FROM n)
SELECT doc_id, sha256({_JOIN}) AS sha256 FROM o GROUP BY doc_id"""
)
MIXED_IMAGES = _WITH_MD + r"SELECT doc_id, sha256(regexp_replace(md, '!\[\[([^\]\r\n]+)\]\]\(([^)\r\n]+)\)', '![\1](\2)', 'g')) AS sha256 FROM md"
NOISE_MD = (
    _WITH_LN
    + f""", o AS (SELECT *, doc_id % 5 = 0 AND line_no <= 6 + CASE WHEN doc_id % 4 <> 3 THEN 7 ELSE 0 END AND line_no > CASE WHEN doc_id % 4 <> 3 THEN 7 ELSE 0 END AS noise FROM ln)
SELECT doc_id, sha256(string_agg(line, {_NL} ORDER BY line_no) FILTER (NOT noise)) AS sha256, count(*) FILTER (noise) AS n_removed,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_chrome, CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_labels, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_pre_title
FROM o GROUP BY doc_id"""
)
NOISE_PAGES = f"""
WITH RECURSIVE ln AS (SELECT page_id, coalesce(html, '') AS html, unnest(string_split(coalesce(html, ''), {_NL})) AS line, CAST(generate_subscripts(string_split(coalesce(html, ''), {_NL}), 1) AS BIGINT) AS no FROM pages),
m AS (SELECT page_id, no, line, regexp_matches(line, '(?i)^\\s*<(?:nav|script|style|noscript)\\b') AS o, regexp_matches(line, '(?i)</(?:nav|script|style|noscript)>\\s*$') AS c FROM ln),
s AS (SELECT page_id, no, line, o AS noise, o AND NOT c AS inside FROM m WHERE no = 1
      UNION ALL
      SELECT m.page_id, m.no, m.line, s.inside OR m.o, (s.inside OR m.o) AND NOT m.c FROM s JOIN m ON m.page_id = s.page_id AND m.no = s.no + 1)
SELECT page_id, count(*) FILTER (noise) AS n_removed, CAST(coalesce(length(string_agg(line, {_NL} ORDER BY no) FILTER (NOT noise)), 0) AS BIGINT) AS n_chars FROM s GROUP BY page_id"""
_MARKERS = ("鍙", "浜", "琛", "璁", "鏈", "鈥", "銆", "�", "Ã", "Â", "â€")
_SCORE = " + ".join(f"CAST((length(md) - length(replace(md, '{m}', ''))) / {len(m)} AS BIGINT)" for m in _MARKERS)
MOJIBAKE = _WITH_MD + f"SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score FROM md"
MOJIBAKE_REPAIRED = _WITH_MD + "SELECT doc_id, CAST(0 AS BIGINT) AS residual, doc_id % 9 = 5 AS changed, sha256(replace(md, 'cafÃ© au lait', 'café au lait')) AS sha256 FROM md"
FRONTMATTER = """SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN 'Paper ' || CAST(doc_id AS VARCHAR) END AS title,
CASE WHEN doc_id % 4 <> 3 THEN 'P' || CAST(doc_id AS VARCHAR) || ';Paper ' || CAST(doc_id AS VARCHAR) || ' notes' ELSE '' END AS aliases, CASE WHEN doc_id % 4 <> 3 THEN 'paper;t' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END AS tags FROM documents"""
FRONTMATTER_ENSURED = (
    f"WITH md0 AS (SELECT doc_id, source FROM documents), {ORACLE_MD}, "
    + f"""t AS (SELECT md.doc_id, md, '"Paper ' || CAST(md.doc_id AS VARCHAR) || ' of ' || source || '"' AS title FROM md JOIN md0 USING (doc_id))
SELECT doc_id, sha256(CASE WHEN doc_id % 4 <> 3 THEN '---' || {_NL} || substr(md, 5, strpos(substr(md, 5), {_NL} || '---' || {_NL}) - 1) || {_NL} || 'status: "clean"' || {_NL} || '---' || {_NL} || substr(md, 5 + strpos(substr(md, 5), {_NL} || '---' || {_NL}) + 4)
ELSE '---' || {_NL} || 'title: ' || title || {_NL} || 'aliases: [' || title || ']' || {_NL} || 'status: "clean"' || {_NL} || '---' || {_NL} || {_NL} || md END) AS sha256 FROM t"""
)
BILINGUAL = "SELECT doc_id, e.english, e.chinese FROM documents, (VALUES ('English one.', '中文一。'), ('English two.', '中文二。'), ('English three.', '中文三。')) AS e(english, chinese) WHERE doc_id % 10 = 6"
BILINGUAL_COLLAPSED = _WITH_MD + "SELECT doc_id, sha256(regexp_replace(md, '> (English (?:one|two|three)\\.)\\n\\n中文[一二三]。', '\\1' || chr(10) || chr(10), 'g')) AS sha256 FROM md"
TABLES = (
    _WITH_LN
    + f"""SELECT doc_id, CAST(1 AS BIGINT) AS table_no, min(line_no) AS start_line, CAST(min(line_no) + CASE WHEN doc_id % 8 = 3 THEN 3 ELSE 0 END AS BIGINT) AS end_line,
CASE WHEN doc_id % 8 = 3 THEN '<table>' || {_NL} || '<tr><td>a</td><td>b</td></tr>' || {_NL} || '<tr><td>1</td><td>2</td></tr>' || {_NL} || '</table>' ELSE '<table><tr><td colspan="2">a</td></tr><tr><td>1</td><td>2</td></tr></table>' END AS fragment
FROM ln WHERE line LIKE '<table%' GROUP BY doc_id"""
)
TABLES_CLASSIFIED = "SELECT doc_id, CAST(1 AS BIGINT) AS table_no, CAST(2 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_columns, CASE WHEN doc_id % 8 = 4 THEN 'colspan' ELSE '' END AS flags, 'convert' AS status FROM documents WHERE doc_id % 8 IN (3, 4)"
TABLES_MD = (
    _WITH_MD
    + f"""SELECT doc_id, sha256(replace(replace(md, '<table>' || {_NL} || '<tr><td>a</td><td>b</td></tr>' || {_NL} || '<tr><td>1</td><td>2</td></tr>' || {_NL} || '</table>', '| a | b |' || {_NL} || '| --- | --- |' || {_NL} || '| 1 | 2 |'),
'<table><tr><td colspan="2">a</td></tr><tr><td>1</td><td>2</td></tr></table>', '| a | a |' || {_NL} || '| --- | --- |' || {_NL} || '| 1 | 2 |')) AS sha256 FROM md"""
)
UNMATCHED = _WITH_MD + r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(md, '(?is)<table\b[^>]*>.*?</table>', '', 'g'), '(?i)</?table\b[^>]*>')) AS BIGINT) AS n FROM md"

FOOTNOTES = """SELECT doc_id, CAST(v.label AS INTEGER) AS label, v.content, false AS quoted FROM documents,
(VALUES (1, 'J. Doe, A study of things. Journal of X, 2001.'), (2, 'a plain remark that goes on'), (3, 'A. Roe, Other things. arXiv, 2003.')) AS v(label, content) WHERE doc_id % 5 = 2"""
FOOTNOTES_CLASSIFIED = f"""
WITH d AS ({FOOTNOTES}),
s AS (SELECT doc_id, label, regexp_matches(content, '(?i)\\b(?:arxiv|doi|isbn|proceedings|journal|conference|transactions|vol\\.?|pp\\.?|springer|elsevier|ieee|acm)\\b|https?://') AS signal,
      regexp_matches(content, '(?i)\\b(?:18|19|20)\\d{{2}}[a-z]?\\b') AS year, regexp_matches(content, '^(?:[A-Z]\\.[ \\t]*){{1,3}}[A-Z][A-Za-z.-]+(?:\\s*,|\\s+and\\s+)') AS author FROM d),
o AS (SELECT *, (year AND (signal OR author)) OR (author AND signal) AS own FROM s),
g AS (SELECT doc_id, max(label) - min(label) + 1 = count(*) AS whole, count(*) AS n, avg(CAST(own AS INTEGER)) AS owns FROM o GROUP BY doc_id)
SELECT doc_id, label, own OR (whole AND n >= 3 AND owns >= 0.6 AND signal) AS is_citation FROM o JOIN g USING (doc_id)"""
# Labels 1 and 3 collide with existing entries, so notes that keep them stay as they are; 11 and 13 move.
FOOTNOTES_MOVED = _WITH_MD + f"SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN '1,3' ELSE '' END AS conflicts, sha256(CASE WHEN doc_id % 10 = 2 THEN {_replaced('md', _MOVED)} ELSE md END) AS sha256 FROM md"
REFERENCES = """SELECT doc_id, CAST(v.n AS INTEGER) AS number, replace(v.entry, '@', CAST(doc_id AS VARCHAR)) AS entry FROM documents,
(VALUES (1, 'Smith, A. and Lee, B. Learning things. Journal of Tests, 2000.'), (2, 'Doe, J. A study of longer things. arXiv 2001.'), (3, 'Roe, R. Notes @. 2002. ' || chr(92) || '[cs.LG' || chr(92) || ']')) AS v(n, entry)"""
REFERENCES_STRUCTURED = _WITH_MD + f"SELECT doc_id, sha256({_replaced('md', _STRUCTURED)}) AS sha256 FROM md"
CITATIONS = (
    _WITH_LN
    + r""", x AS (SELECT doc_id, count(*) AS n_lines FROM ln GROUP BY doc_id)
SELECT doc_id, n_lines, CAST(3 AS BIGINT) AS n_refs,
  CAST(7 + 1 + 1 + 1 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_links, CAST(1 AS BIGINT) AS n_unresolved FROM x"""
)
CITATIONS_TEXT = _WITH_MD + f"SELECT doc_id, sha256({_replaced('md', _REWRITTEN)}) AS sha256 FROM md"
CAPTIONS = _WITH_MD + """SELECT doc_id, sha256(replace(md, 'Results over 10 10 trials', 'Results over $10$ trials')) AS sha256, CAST(len(regexp_extract_all(md, '(?m)^\\s*(?:>\\s*)?(?i:Figure|Fig\\.?|图)\\s*[A-Za-z]?\\d+\\s*[:：]')) AS BIGINT) AS captions,
CAST(1 AS BIGINT) AS fixed, CAST(0 AS BIGINT) AS residual FROM md"""
AUTHOR_YEARS = """SELECT doc_id, CAST(v.n AS INTEGER) AS number, v.k AS author_key, v.y AS year FROM documents, (VALUES (1, 'smith', '2000'), (2, 'doe', '2001'), (3, 'roe', '2002')) AS v(n, k, y)"""
NAMED = "SELECT doc_id, v.k AS key, CAST(v.n AS BIGINT) AS nth FROM documents, (VALUES ('doe2001', 1), ('roe2002', 2)) AS v(k, n) WHERE doc_id % 6 = 4"
NAMED_RESOLVED = _WITH_MD + f"SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 4 THEN {_replaced('md', _NAMED)} ELSE md END) AS sha256 FROM md"
DANGLING = "SELECT doc_id, CAST(9 AS INTEGER) AS number FROM documents"
SUBJECTS = _WITH_MD + f"SELECT doc_id, sha256({_replaced('md', _SUBJECT)}) AS sha256 FROM md"
PIPES = _WITH_MD + "SELECT doc_id, sha256(replace(md, '| a | [[#^ref-1|¹]] |', '| a | [[#^ref-1' || chr(92) || '|¹]] |')) AS sha256 FROM md"
_ALL = _REWRITTEN | _PIPES | {k.replace("\\[cs.LG\\]", "[cs.LG]"): v.replace("\\[cs.LG\\]", "[cs.LG]") for k, v in _STRUCTURED.items()}
_ALL_NAMED = _ALL | {"[cs.LG] ^ref-3\n\n## Appendix": "[cs.LG] ^ref-3\n\n[4] Doe. One. 2001 ^ref-4\n\n[5] Roe. Two. 2002 ^ref-5\n\n## Appendix"} | dict([next(iter(_NAMED.items()))])
NORMALIZED = _WITH_MD + f"SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 4 THEN {_replaced(_replaced('md', _SUBJECT), _ALL_NAMED)} ELSE {_replaced(_replaced('md', _SUBJECT), _ALL)} END) AS sha256 FROM md"

FIGURES = """SELECT doc_id, '1' AS figure_id, 'images/f' || CAST(doc_id % 9 AS VARCHAR) || '.png' AS target, 'unique' AS status FROM documents
UNION ALL SELECT doc_id, '2', NULL, 'multi_asset' FROM documents WHERE doc_id % 7 = 2"""
MENTIONS = """WITH m AS (SELECT doc_id, v.* FROM documents, (VALUES ('range', '-'), ('plural', '1'), ('plural', '2'), ('single', '1'), ('single', '3'), ('single', '1')) AS v(kind, fig)),
s AS (SELECT doc_id, kind, CASE WHEN kind = 'range' THEN 'range' WHEN fig = '1' THEN 'linked' WHEN fig = '2' AND doc_id % 7 = 2 THEN 'ambiguous_target' ELSE 'missing_target' END AS status FROM m)
SELECT doc_id, kind, status, count(*) AS n FROM s GROUP BY doc_id, kind, status"""
FIGURES_TEXT = _WITH_MD + """, f AS (SELECT doc_id, replace(md, '![[fig a]]', '![fig a]') AS md, '](images/f' || CAST(doc_id % 9 AS VARCHAR) || '.png)' AS u FROM md)
SELECT doc_id, sha256(replace(md, 'See Figure 1, Figs. 1 and 2, Figures 1-2 and Fig.~3; 图 1 too, not', 'See [Figure 1' || u || ', Figs. [1' || u || ' and 2, Figures 1-2 and Fig. 3; [图 1' || u || ' too, not')) AS sha256 FROM f"""
ORPHANS = "SELECT doc_id, 'fig-9' AS anchor FROM documents"
ORPHANS_STRIPPED = _WITH_MD + "SELECT doc_id, sha256(replace(md, '[[#fig-9|b]]', 'b')) AS sha256 FROM md"
BROKEN = """SELECT doc_id, v.reason, CAST(1 AS BIGINT) AS n FROM documents, (VALUES ('absolute_or_external'), ('missing_attachment')) AS v(reason)
UNION ALL SELECT doc_id, 'wrong_figure', CAST(1 AS BIGINT) FROM documents WHERE doc_id % 2 = 0"""

_UNITS = (
    _REG
    + f""", u1 AS (SELECT *, region <> '.' OR h OR trim(line) = '' OR regexp_matches(trim(line), '^!\\[[^\\]]*\\]\\([^)]+\\)$') OR regexp_matches(trim(line), '^(?:\\||<table|<tr)') AS dropped,
  regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+\\S') AS item, last_value(CASE WHEN h THEN trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM reg),
u2 AS (SELECT *, dropped OR item OR coalesce(lag(item AND NOT dropped) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS breaks FROM u1),
u3 AS (SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM u2),
u4 AS (SELECT doc_id, min(line_no) AS line_no, min_by(section, line_no) AS section, regexp_replace(string_agg(line, {_NL} ORDER BY line_no), '\\A\\s+|\\s+\\z', '', 'g') AS raw FROM u3 WHERE NOT dropped GROUP BY doc_id, island),
u5 AS (SELECT *, CASE WHEN lower(section) = 'abstract' THEN 'abstract' WHEN lower(raw) LIKE 'keywords:%' THEN 'keywords' WHEN regexp_matches(lower(raw), '^(?:figure |fig\\. |fig |table )') THEN 'caption'
  WHEN NOT contains(raw, {_NL}) AND regexp_matches(raw, '^\\s*(?:[-*+]|\\d+[.)])\\s+\\S') THEN 'list_item' ELSE 'paragraph' END AS kind FROM u4 WHERE raw <> '' AND raw NOT LIKE '>%'),
u6 AS (SELECT *, CASE WHEN kind = 'list_item' THEN regexp_replace(raw, '^\\s*(?:[-*+]|\\d+[.)])\\s+', '') ELSE raw END AS english FROM u5),
u7 AS (SELECT *, CASE WHEN english = 'ICRA2024' THEN 'identity' WHEN english = '</table>' THEN 'markup' END AS reason FROM u6),
un AS (SELECT doc_id, 'u' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS VARCHAR), 5, '0') AS unit_id, CASE WHEN reason IS NOT NULL THEN 'passthrough' ELSE kind END AS kind, english, reason FROM u7) """
)
_WITH_UN = "WITH " + _UNITS
UNITS = _WITH_UN + "SELECT doc_id, unit_id, kind, sha256(english) AS source_sha256 FROM un"
PASSTHROUGH = _WITH_UN + "SELECT doc_id, unit_id, english, reason FROM un WHERE reason IS NOT NULL"
PACKETS = (
    _WITH_UN
    + """SELECT doc_id, count(*) AS n_units, count(*) FILTER (reason IS NULL) AS n_required, count(*) FILTER (kind = 'passthrough') AS n_passthrough, count(*) FILTER (kind = 'abstract') AS n_abstract, count(*) FILTER (kind = 'keywords') AS n_keywords,
count(*) FILTER (kind = 'caption') AS n_captions, count(*) FILTER (kind = 'list_item') AS n_list_items, count(*) FILTER (kind = 'paragraph') AS n_paragraphs, CAST(sum(length(english)) AS BIGINT) AS n_chars FROM un GROUP BY doc_id"""
)
ROUNDTRIP = "SELECT doc_id, true AS same, true AS intact FROM documents"
_DOC_UNITS = "du AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS unit_id, text, sha256(sha256(text) || chr(0) || 'paragraph' || chr(0) || 'unit-contract-1') AS cache_key FROM documents)"
PENDING = f"""WITH {_DOC_UNITS}, c AS (SELECT DISTINCT cache_key FROM du JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND quality = 1)
SELECT doc_id, CASE WHEN c.cache_key IS NULL THEN 'pending' ELSE 'cached' END AS state FROM du LEFT JOIN c USING (cache_key)"""
UPSERT = f"""WITH {_DOC_UNITS}, c AS (SELECT cache_key, doc_id FROM du JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
SELECT cache_key, '译' || CAST(max(doc_id) AS VARCHAR) AS zh FROM c GROUP BY cache_key"""
_RESULTS = """w AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 0 THEN 'no' ELSE '译文' END AS zh FROM labels),
res AS (SELECT unit_id, zh FROM w UNION ALL SELECT unit_id, zh FROM w WHERE doc_id % 10 = 3 UNION ALL SELECT 'x' || unit_id, zh FROM w WHERE doc_id % 10 = 4)"""
_ERRORS = f"""{_DOC_UNITS}, {_RESULTS}, g AS (SELECT unit_id, count(*) AS n, min(zh) AS zh FROM res GROUP BY unit_id),
b AS (SELECT unit_id, doc_id IS NOT NULL AS known, n, zh FROM du FULL OUTER JOIN g USING (unit_id)),
e AS (SELECT unit_id, 'unknown_unit' AS error FROM b WHERE NOT known UNION ALL SELECT unit_id, 'missing_unit' FROM b WHERE n IS NULL UNION ALL SELECT unit_id, 'duplicate_unit' FROM b WHERE n > 1
 UNION ALL SELECT unit_id, 'empty' FROM b WHERE n IS NOT NULL AND zh = '' UNION ALL SELECT unit_id, 'no_cjk' FROM b WHERE known AND n IS NOT NULL AND zh IN ('', 'no'))"""
CONTRACT = f"WITH {_ERRORS} SELECT error, count(*) AS n FROM e GROUP BY error"
COMBINED = f"WITH {_RESULTS}, u AS (SELECT DISTINCT unit_id, zh FROM res) SELECT unit_id, zh FROM u UNION ALL SELECT CAST(doc_id AS VARCHAR), '旧' FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT unit_id FROM u)"
IMPORT = f"WITH {_ERRORS} SELECT (SELECT count(*) FROM du) AS n_units, count(DISTINCT unit_id) AS n_invalid, CASE WHEN count(DISTINCT unit_id) = 0 THEN 'valid' WHEN count(DISTINCT unit_id) < 5 THEN 'partial' ELSE 'failed' END AS status FROM e"
MERGED = _WITH_UN + f""", n AS (SELECT doc_id, line_no, raw, kind AS base, english, reason, 'u' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS VARCHAR), 5, '0') AS unit_id FROM u7),
s AS (SELECT doc_id, dropped, min(line_no) AS line_no, string_agg(line, {_NL} ORDER BY line_no) AS whole FROM u3 GROUP BY doc_id, island, dropped),
q AS (SELECT *, CASE WHEN reason IS NULL AND base = 'list_item' THEN regexp_extract(raw, '^\\s*(?:[-*+]|\\d+[.)])\\s+') ELSE '' END AS bullet FROM n),
p AS (SELECT s.doc_id, s.line_no, CASE WHEN q.doc_id IS NULL THEN whole ELSE
  array_to_string(list_transform(string_split(bullet || english, {_NL}), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), {_NL}) || {_NL} || {_NL} || bullet || CASE WHEN reason IS NULL THEN '译文 ' || unit_id ELSE english END END AS piece
  FROM s LEFT JOIN q ON s.doc_id = q.doc_id AND s.line_no = q.line_no AND NOT s.dropped)
SELECT doc_id, true AS complete, sha256(string_agg(piece, {_NL} ORDER BY line_no)) AS sha256 FROM p GROUP BY doc_id"""

CONCEPTS = """
WITH v AS (SELECT 'concepts/' || p_name || '.md' AS path, p_name AS target, p_name || ' (size ' || CAST(p_size AS VARCHAR) || ')' AS h, p_name, p_brand, p_type || ' ' || CAST(p_partkey AS VARCHAR) AS t, 'size ' || CAST(p_size AS VARCHAR) AS paren FROM part),
s AS (SELECT path, target, trim(p_name) AS surface, 1 AS rank FROM v UNION SELECT path, target, trim(p_brand), 2 FROM v UNION SELECT path, target, trim(t), 2 FROM v UNION SELECT path, target, trim(paren), 3 FROM v UNION SELECT path, target, trim(h), 3 FROM v),
ok AS (SELECT target FROM s GROUP BY target HAVING count(DISTINCT path) = 1),
f AS (SELECT * FROM s SEMI JOIN ok USING (target) WHERE surface <> '' AND length(surface) >= 3 AND length(surface) <= 80),
g AS (SELECT surface, count(DISTINCT target) AS n, min(target) AS target, min(rank) AS rank FROM f GROUP BY surface)
SELECT surface, target, CASE rank WHEN 1 THEN 'stem' WHEN 2 THEN 'alias' ELSE 'heading' END AS provenance, rank < 3 AS auto_write FROM g WHERE n = 1"""
EXACT_TITLE = "WITH w AS (SELECT DISTINCT ' ' || upper(p_name) AS wanted FROM part) SELECT wanted, p_partkey AS \"itemID\", 'K' || CAST(p_partkey AS VARCHAR) AS key FROM part JOIN w ON lower(trim(p_name)) = lower(trim(wanted)) WHERE p_size % 10 <> 0"
TOP3 = r"""
WITH w(wanted) AS (VALUES ('Red Widget'), ('widget'), ('Ring of nothing'), ('gear'), ('no such title')),
t AS (SELECT 'K' || CAST(p_partkey AS VARCHAR) AS key, p_name AS title FROM part WHERE p_size % 10 <> 0),
a AS (SELECT wanted, list_filter(regexp_split_to_array(wanted, '\W+'), lambda x: length(x) >= 4) AS words FROM w),
n AS (SELECT wanted, lower(CASE WHEN len(words) > 0 THEN array_to_string(words[1:5], ' ') ELSE trim(wanted) END) AS needle, lower(words[1]) AS word FROM a),
h AS (SELECT wanted, key, title, contains(lower(title), needle) AS full_ FROM t JOIN n ON contains(lower(title), coalesce(word, needle))),
b AS (SELECT DISTINCT wanted, key, title FROM (SELECT *, max(CAST(full_ AS INTEGER)) OVER (PARTITION BY wanted) AS any_ FROM h) WHERE CAST(full_ AS INTEGER) = any_)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY length(title), title, key) AS rank FROM b) WHERE rank <= 3"""
ATTACHMENTS = """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'application/pdf' END AS ct, 'storage:' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '.pdf' ELSE '.txt' END AS path FROM lineitem)
SELECT l_suppkey AS "parentItemID", count(*) AS n, count(DISTINCT l_partkey) AS n_keys, '/data/storage/' || substr(min(path), 9) AS first_path FROM a JOIN part ON p_partkey = l_partkey WHERE p_size % 10 <> 0 AND (ct = 'application/pdf' OR path LIKE '%.pdf') GROUP BY l_suppkey"""
RESOLUTION = """
WITH h AS (SELECT CAST(doc_id % 3 AS INTEGER) AS priority, 'v/' || CAST(doc_id AS VARCHAR) || '.md' AS path, 't ' || CAST(doc_id % 500 AS VARCHAR) AS k FROM documents),
w AS (SELECT 't  ' || CAST(doc_id AS VARCHAR) AS wanted, 't ' || CAST(doc_id AS VARCHAR) AS k FROM documents),
p AS (SELECT wanted, priority, count(path) AS n, min(path) AS path FROM w LEFT JOIN h USING (k) GROUP BY wanted, priority),
f AS (SELECT wanted, min(priority) AS priority FROM p WHERE n > 0 GROUP BY wanted)
SELECT w.wanted, CASE WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN p.n = 1 THEN p.path END AS path, f.priority FROM w LEFT JOIN f USING (wanted) LEFT JOIN p ON p.wanted = w.wanted AND p.priority = f.priority"""
_BOXES = "box AS (SELECT l_orderkey AS doc_id, CAST(0 AS INTEGER) AS page, CASE WHEN l_linenumber = 1 THEN 'image' ELSE 'text' END AS kind, CAST((l_partkey % 5) * 100 AS DOUBLE) AS x0, CAST((l_suppkey % 7) * 40 AS DOUBLE) AS y0, CAST((l_partkey % 5) * 100 AS DOUBLE) + 120 + l_quantity * 4 AS x1, CAST((l_suppkey % 7) * 40 AS DOUBLE) + 30 + l_quantity AS y1 FROM lineitem)"
BOUNDS = f"WITH {_BOXES} SELECT doc_id, page, min(x0) AS \"left\", min(y0) AS top, max(x1) AS \"right\", max(y1) AS bottom FROM box GROUP BY doc_id, page"
LAYOUT = f"""WITH {_BOXES}, b AS (SELECT doc_id, max(x1) - min(x0) AS content FROM box GROUP BY doc_id),
i AS (SELECT box.*, content FROM box JOIN b USING (doc_id) WHERE kind = 'image'),
j AS (SELECT i.doc_id, i.page, i.content, i.x0, i.y0, i.x1, i.y1, t.x0 AS tx0, t.x1 AS tx1, greatest(0.0, least(i.y1, t.y1) - greatest(i.y0, t.y0)) AS ov, least(i.y1 - i.y0, t.y1 - t.y0) AS low FROM i LEFT JOIN box t ON t.doc_id = i.doc_id AND t.kind = 'text'),
k AS (SELECT *, ov >= greatest(8.0, low * 0.18) AND tx1 - tx0 >= content * 0.22 AS ok, CASE WHEN tx0 >= x1 - content * 0.035 THEN 'l' WHEN tx1 <= x0 + content * 0.035 THEN 'r' END AS side FROM j),
s AS (SELECT doc_id, page, content, x0, y0, x1, y1, coalesce(sum(ov) FILTER (ok AND side = 'l'), 0.0) AS l, coalesce(sum(ov) FILTER (ok AND side = 'r'), 0.0) AS r FROM k GROUP BY ALL),
f AS (SELECT *, (x1 - x0) / content AS fr, (x1 - x0) / content <= 0.56 AND greatest(l, r) >= greatest(8.0, (y1 - y0) * 0.12) AND l <> r AS fl FROM s)
SELECT doc_id, page, round(fr, 3) AS width_fraction, CASE WHEN NOT fl THEN 'center' WHEN l > r THEN 'float_left' ELSE 'float_right' END AS recommendation, CASE WHEN fl THEN round(least(1.0, greatest(l, r) / ((y1 - y0) * 0.45)), 3) ELSE 0.0 END AS confidence FROM f"""
ASSETS = """WITH r AS (SELECT trim(url) AS source, false AS critical FROM pages UNION ALL SELECT 'https://x.org/' || CAST(page_id % 20 AS VARCHAR) || '.png', true FROM pages),
p AS (SELECT source, bool_or(critical) AS critical, count(*) AS n FROM r GROUP BY source),
s AS (SELECT *, CASE WHEN regexp_matches(source, '^https://x.org/[0-4].png$') THEN 'hit' WHEN critical THEN 'fetch' ELSE 'defer' END AS status FROM p)
SELECT status, critical, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_references FROM s GROUP BY status, critical"""

METRICS = (
    _WITH_MD
    + f"""SELECT doc_id, CAST(len(list_filter(string_split(md, {_NL}), lambda x: x LIKE '>%')) AS BIGINT) AS n_quotes,
CAST(len(list_filter(string_split(md, {_NL}), lambda x: regexp_matches(x, '[一-鿿]') AND x NOT LIKE '>%')) AS BIGINT) AS n_chinese,
CAST(list_sum(list_transform(string_split(md, '$$'), lambda g: len(regexp_extract_all(g, '\\$[^$\\n]+\\$')))) AS BIGINT) AS n_formulas,
CAST(len(string_split(md, '$$')) - 1 AS BIGINT) AS n_display, CAST(len(string_split(md, '![')) - 1 AS BIGINT) AS n_images, CAST(len(string_split(md, '[[#^ref-')) - 1 AS BIGINT) AS n_citations,
CAST(0 AS BIGINT) AS n_blocks, sha256(md) AS sha256 FROM md"""
)
_FOUND = {
    "abstract_h2": ("error", "regexp_matches(md, '(?m)^(?:#|#{3,6})\\s+Abstract$')"),
    "author_years_left": ("warning", "regexp_matches(md, '\\([^()]*et al\\.[^()]*2001\\)')"),
    "bibliographic_footnotes_left": ("error", "regexp_matches(md, '(?m)^\\[\\^\\d\\]:.*Journal')"),
    "block_ids_missing": ("error", "regexp_matches(md, '(?m)^\\[1\\] ') AND NOT regexp_matches(md, '(?m)\\^ref-\\d+$')"),
    "dangling_links": ("error", "contains(md, '[[#^ref-9|')"),
    "footnotes_of_entries": ("error", "regexp_matches(md, '\\[\\^[123]\\]')"),
    "frontmatter_missing": ("error", "md NOT LIKE '---%'"),
    "html_tags": ("warning", "regexp_matches(md, '</?(?:table|tr|td|div|span|nav)\\b')"),
    "image_outside_roots": ("warning", "regexp_matches(md, '!\\[[^\\]]*\\]\\([^):/]+\\.png\\)')"),
    "mojibake": ("error", f"({_SCORE}) > 0"),
    "named_keys_left": ("error", "contains(md, chr(92) || '[doe2001')"),
    "odd_display_math": ("error", "(len(string_split(md, '$$')) - 1) % 2 = 1"),
    "odd_dollars": ("warning", "len(regexp_extract_all(replace(replace(md, '$$', ''), chr(92) || '$', ''), '\\$')) % 2 = 1"),
    "one_h1": ("error", "len(regexp_extract_all(regexp_replace(md, '```[^`]*```', '', 'g'), '(?m)^# ')) <> 1"),
    "raw_numbers_left": ("error", "contains(md, 'Prior work [1, 2]')"),
}
FINDINGS = _WITH_MD + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS severity, '{r}' AS rule FROM md WHERE {c}" for r, (s, c) in _FOUND.items())
_OF = {kind: " + ".join(f"CAST({c} AS BIGINT)" for s, c in _FOUND.values() if s == kind) for kind in ("error", "warning")}
READINESS = _WITH_MD + f"SELECT doc_id, {_OF['error']} AS n_errors, {_OF['warning']} AS n_warnings, {_OF['error']} = 0 AS ready FROM md"
PLACEMENT = "SELECT doc_id, CAST(1 AS BIGINT) AS n, CAST(3 AS BIGINT) AS n_links FROM documents WHERE doc_id % 3 = 1"
BILINGUAL_LAYOUT = _WITH_UN + "SELECT doc_id, count(*) FILTER (reason IS NULL) AS n_units, count(*) FILTER (reason IS NULL) AS n_found, count(*) FILTER (reason IS NULL) AS n_translated FROM un GROUP BY doc_id"

DURATIONS = """SELECT user_id AS workflow_id, event_type AS stage, epoch_us(max(ts) FILTER (event_id % 2 = 1)) // 1000 - epoch_us(max(ts) FILTER (event_id % 2 = 0)) // 1000 AS duration_ms FROM events GROUP BY user_id, event_type"""
STATE = "SELECT user_id AS workflow_id, event_type AS stage, CASE WHEN max_by(event_id, (ts, event_id)) % 2 = 0 THEN 'started' ELSE 'finished' END AS status, count(*) AS n_events FROM events GROUP BY user_id, event_type"
ATTEMPTS = "SELECT event_id, row_number() OVER w AS attempt, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 AS gap_ms FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"
FAILURES = """WITH f AS (SELECT CASE WHEN event_id % 6 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 4 < 2 THEN 'network_transport' ELSE 'worker_process' END
WHEN event_id % 7 = 0 THEN 'runtime_mismatch' WHEN event_id % 3 > 0 THEN 'output_contract' WHEN event_id % 2 > 0 THEN 'unit_validation' ELSE 'unknown' END AS failure FROM events)
SELECT CASE WHEN failure = 'runtime_mismatch' THEN 'runtime_attestation' WHEN failure IN ('timeout', 'network_transport', 'worker_process') THEN 'worker_process' ELSE 'output_validation' END AS stage, failure, failure <> 'runtime_mismatch' AS retryable, count(*) AS n FROM f GROUP BY failure"""
ASSIGNMENTS = """SELECT doc_id, CAST(to_json({'schema_version': 3, 'packet_path': '/w/in/' || doc_id || '.jsonl', 'output_path': '/w/out/' || doc_id || '.jsonl', 'unit_count': n_chars, 'packet_sha256': sha256(coalesce(text, '')),
'prompt_sha256': sha256('Translate.'), 'translator_fingerprint': sha256('m1' || chr(0) || 'high' || chr(0) || sha256('Translate.') || chr(0) || 'c1' || chr(0) || 't1'), 'constraints_version': 'c1',
'requested_runtime': {'model': 'm1', 'reasoning_effort': 'high', 'quality_tier': 'publication'}}) AS VARCHAR) AS assignment FROM documents"""
LEADING_MATH = """WITH s AS (SELECT doc_id, '$' || chr(92) || 'alpha_{' || CAST(doc_id % 3 AS VARCHAR) || '}$' AS tok, CASE doc_id % 4 WHEN 0 THEN 'α' WHEN 1 THEN '<sub>1</sub> ' WHEN 2 THEN 'beta ' ELSE '' END AS pre FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN tok ELSE pre END || '的研究 α' AS title FROM s"""
DRIFT = "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0"
INCREMENTAL = "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 4 IN (2, 3) THEN 'reused' ELSE 'read' END AS state FROM documents"
RETENTION = "SELECT name, label, file FROM (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderstatus AS label, CAST(o_orderkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS n FROM orders) WHERE n > 2"
FROZEN = "SELECT c_custkey AS workflow_id, c_mktsegment AS artifact, CASE WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM customer WHERE c_custkey % 5 IN (0, 1)"
EDITS = _WITH_MD + "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'unknown_type' END, CASE WHEN doc_id % 7 = 0 THEN 'before_differs' END) AS errors, sha256(CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN md ELSE replace(md, '- item one', '* item one') END) AS sha256 FROM md"
MIGRATION = "SELECT count(*) AS notes_scanned, count(*) FILTER (doc_id % 2 = 0) AS notes_changed, CAST(-2 * count(*) FILTER (doc_id % 2 = 0) AS BIGINT) AS chars_added FROM documents"
BY_SOURCE = _WITH_UN + ", n AS (SELECT doc_id, count(*) AS n FROM un GROUP BY doc_id) SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_units FROM documents JOIN n USING (doc_id) GROUP BY source"
SLUGS = "SELECT doc_id, 'paper-' || CAST(doc_id AS VARCHAR) || '-of-' || lower(source) AS slug, 'Paper ' || CAST(doc_id AS VARCHAR) || ' of ' || source || ' a b' AS clean FROM documents"

TITLE_UNITS = """SELECT CAST(v.n AS INTEGER) AS number, v.s AS status, count(*) AS n, CASE WHEN v.s = 'pending' THEN count(*) ELSE 0 END AS n_units, v.z AS zh FROM documents,
(VALUES (1, 'pending', NULL), (2, 'pending', NULL), (3, 'reused', '记')) AS v(n, s, z) GROUP BY v.n, v.s, v.z"""
TRANSPORT = _WITH_UN + "SELECT doc_id, kind, count(*) AS n_units, CAST(sum(length(english)) AS BIGINT) AS n_chars, CAST(sum(octet_length(encode(english))) AS BIGINT) AS n_bytes FROM un WHERE reason IS NULL GROUP BY doc_id, kind"
STRIPPED = _WITH_MD + "SELECT doc_id, sha256(md || 'Figure 1 图 2 [other](c) ![Figure 3](d.png)') AS sha256 FROM md"
GROUPS = "SELECT doc_id, '2' AS figure, 'a.png,b.png' AS images FROM documents WHERE doc_id % 7 = 2"
GROUPS_REPLACED = _WITH_MD + f"SELECT doc_id, sha256(replace(md, '![a](a.png)' || {_NL} || '![b](b.png)' || {_NL} || {_NL} || 'Fig. 2', '![Figure 2](crop.png)' || {_NL} || {_NL} || 'Fig. 2')) AS sha256 FROM md"
CROPS = """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber, (l_partkey % 5) * 100.0 AS x0, (l_suppkey % 7) * 40.0 AS y0, (l_partkey % 5) * 100.0 + 120 AS x1, (l_suppkey % 7) * 40.0 + 30 AS y1 FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY x0, y0) = 1),
d AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem),
u AS (SELECT doc_id, count(DISTINCT l_linenumber) AS n, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM d LEFT JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 THEN greatest(0.0, x0 * 500.0 / 1000 - 4) ELSE 0.0 END AS x0, CASE WHEN n > 0 THEN greatest(0.0, y0 * 800.0 / 1000 - 4) ELSE 0.0 END AS y0, CASE WHEN n > 0 THEN least(500.0, x1 * 500.0 / 1000 + 4) END AS x1, CASE WHEN n > 0 THEN least(800.0, y1 * 800.0 / 1000 + 4) END AS y1,
CASE WHEN n < 2 THEN 'missing_image' ELSE 'crop' END AS status FROM u"""
ASSET_SUMMARY = """WITH p AS (SELECT user_id, max(event_id % 100) AS ms, bool_or(event_id % 4 = 0) AS got, count(*) AS n FROM events GROUP BY user_id)
SELECT CAST(sum(n) AS BIGINT) AS n_assets, count(*) AS n_sources, count(*) FILTER (got) AS n_downloaded, count(*) FILTER (NOT got) AS n_hits, CAST(0 AS BIGINT) AS n_failed, CAST(sum(ms) AS BIGINT) AS download_ms FROM p"""
ALIGNMENT = """SELECT 'n' || CAST(doc_id AS VARCHAR) || '.md' AS note, CASE WHEN doc_id % 2 = 0 THEN 'preserved_existing' ELSE 'added' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'center' END AS position,
CASE WHEN doc_id % 2 = 0 THEN '10' ELSE '' END AS width, doc_id % 2 = 0 AS wrap, doc_id % 3 = 0 AS float_candidate FROM documents"""
PACKAGES = """SELECT CAST(c_custkey AS VARCHAR) AS item_key, max('p/' || CAST(o_orderkey AS VARCHAR)) AS path FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND (c_custkey % 2 <> 0 OR o_orderpriority = '1-URGENT') GROUP BY c_custkey"""
PATHS = """SELECT doc_id, '../../_resources/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.png' AS relative, CASE WHEN lang IS NOT NULL THEN false END AS within,
'translate_' || source || '_' || substr(sha256('/v/notes/' || source || '/workflow'), 1, 16) || '_a2' AS task FROM documents"""

_FRONT = f"regexp_extract(md, '^---' || {_NL} || '(.*?)' || {_NL} || '---', 1, 's')"
TRIAGE = _WITH_MD + """, t AS (SELECT doc_id, md, regexp_extract_all(md, '(?is)<table\\b[^>]*>.*?</table>') AS found, regexp_replace(md, '(?is)<table\\b[^>]*>.*?</table>', '', 'g') AS rest FROM md)
SELECT doc_id, CAST(len(found) AS BIGINT) AS n_tables, CAST(len(found) AS BIGINT) AS n_convert, CAST(0 AS BIGINT) AS n_review, CAST(len(regexp_extract_all(rest, '(?i)</?table\\b[^>]*>')) AS BIGINT) AS n_unmatched FROM t"""
CONCEPT_NOTES = _WITH_MD + f"SELECT 'notes/' || CAST(doc_id AS VARCHAR) || '.md' AS path, sha256(md) AS sha256 FROM md WHERE doc_id <> 3 AND NOT regexp_matches({_FRONT}, '(?m)^  - paper$')"
NUMBER_SETS = _WITH_LN + r""", r AS (SELECT doc_id, line, sum(CASE WHEN line = '## References' THEN 1 ELSE 0 END) OVER w - sum(CASE WHEN line = '## Appendix' THEN 1 ELSE 0 END) OVER w AS inside FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
e AS (SELECT DISTINCT doc_id, CAST(regexp_extract(line, '^\[(\d{1,9})\]\s', 1) AS INTEGER) AS number FROM r WHERE inside > 0 AND regexp_matches(line, '^\[\d{1,9}\]\s')),
l AS (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(line, '\^ref-(\d{1,9})\|', 1)) AS INTEGER) AS number FROM r WHERE inside = 0),
b AS (SELECT coalesce(e.doc_id, l.doc_id) AS doc_id, e.number AS want, l.number AS have FROM e FULL JOIN l ON e.doc_id = l.doc_id AND e.number = l.number)
SELECT doc_id, count(*) FILTER (have IS NULL) AS n_missing, count(*) FILTER (want IS NULL) AS n_unexpected, count(*) FILTER (have IS NULL OR want IS NULL) = 0 AS same FROM b GROUP BY doc_id"""
VALID_UNITS = "SELECT CAST(doc_id AS VARCHAR) AS unit_id, '译文' AS zh FROM labels JOIN documents USING (doc_id) WHERE coalesce(toxic <> 1, true) AND coalesce(quality <> 0, true) AND doc_id % 10 <> 3"
REVIEW = _WITH_MD + """, a AS (SELECT * FROM (VALUES ('references', false), ('ICRA2024', true), ('Paper 1', false)) AS v(surface, exact_))
SELECT doc_id, surface, n FROM (SELECT doc_id, surface, CAST((length(t) - length(replace(t, s, ''))) / length(s) AS BIGINT) AS n FROM (SELECT doc_id, surface, CASE WHEN exact_ THEN md ELSE lower(md) END AS t, CASE WHEN exact_ THEN surface ELSE lower(surface) END AS s FROM md, a)) WHERE n > 0"""

PREPARED = (
    _WITH_UN
    + f""", cf AS ({FOOTNOTES_CLASSIFIED}), fn AS (SELECT doc_id, count(*) AS n FROM cf WHERE is_citation GROUP BY doc_id), fg AS ({FIGURES}), mn AS ({MENTIONS}), mj AS ({MOJIBAKE}),
tg AS (SELECT doc_id, count(*) FILTER (status = 'unique') AS targets, count(*) FILTER (status <> 'unique') AS ambiguous FROM fg GROUP BY doc_id),
mm AS (SELECT doc_id, sum(n) FILTER (kind <> 'range') AS mentions, coalesce(sum(n) FILTER (status = 'missing_target'), 0) AS missing FROM mn GROUP BY doc_id),
uu AS (SELECT doc_id, count(*) AS n, count(*) FILTER (reason IS NULL) AS needed FROM un WHERE english NOT LIKE '![[fig a]]%' GROUP BY doc_id),
cs AS (SELECT doc_id, coalesce(fn.n, 0) + len(regexp_extract_all(md, '\\\\\\[(?:doe|roe)[^\\]]*\\]')) AS citation_residual, 0 AS caption_math_artifact_residual,
  len(regexp_extract_all(md, '!\\[[^\\]]*\\]\\(https?:')) AS remote_images, 0 AS planned_remote_images, len(regexp_extract_all(md, '(?i)<table\\b')) AS html_tables, mj.score AS mojibake,
  len(regexp_extract_all(md, '!\\[[^\\]]*\\]\\([ab]\\.png\\)')) AS invalid_image_paths, CASE WHEN md LIKE '---%' THEN 0 ELSE 1 END AS frontmatter_errors,
  uu.n AS translation_units, uu.n AS body_translation_units, 0 AS reference_title_units, 0 AS reference_title_fallback_units, uu.n - uu.needed AS passthrough_units, uu.n AS layout_units_total, uu.needed AS model_units_total,
  len(regexp_extract_all(md, '\\^ref-\\d+\\s*$')) AS reference_blocks, len(regexp_extract_all(md, '\\{{\\{{(?:REF)?ZH:')) AS placeholders, 0 AS protected_token_errors,
  coalesce(tg.targets, 0) AS figure_targets, mm.mentions AS figure_mentions, 0 AS figure_links_written, mm.missing AS unmatched_figure_mentions, coalesce(tg.ambiguous, 0) AS ambiguous_figure_targets, 0 AS broken_figure_links
  FROM md JOIN uu USING (doc_id) JOIN mm USING (doc_id) JOIN mj USING (doc_id) LEFT JOIN tg USING (doc_id) LEFT JOIN fn USING (doc_id))
SELECT doc_id, false AS ok, false AS ready_for_translation, """
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTERS)
    + " FROM cs"
)
