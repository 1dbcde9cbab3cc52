"""A deterministic Markdown corpus made from the ``documents`` table, for queries and tests.

The driver's documents are plain prose.  This view wraps each whole text in a note that shows
every construct the operators handle, varied by doc_id.  The expression is plain SQL without
backslash escapes, so that Spark and DuckDB read it alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.readers import spread

_NL = "chr(10)"
_ID = "CAST(doc_id AS STRING)"


def _lines(*parts: str) -> str:
    return " || ".join(f"{p} || {_NL}" for p in parts)


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE '' END"


_PARTS = [
    _when("doc_id % 4 <> 3", _lines("'---'", f"'title: \"Paper ' || {_ID} || '\"'", f"'aliases: [P' || {_ID} || ', \"Paper ' || {_ID} || ' notes\"]'", "'tags:'", "'  - paper'", "'  - t' || CAST(doc_id % 7 AS STRING)", "'---'")),
    _when("doc_id % 5 = 0", _lines("'[Skip to main content](#main)'", "'[Home](https://example.org/)'", "'[Up](/papers)'", "'<nav class=\"top\">'", "'[x](/x)'", "'</nav>'")),
    _lines(f"'# Paper ' || {_ID} || ' of ' || source", "''"),
    _when("doc_id % 6 = 1", _lines("'# Second title'", "''")),
    _lines("'###### Abstract'", "''", "'Keywords: spark, notes'", "''"),
    _lines("'Prior work [1, 2] and [3] and [1]–[3] but not [9] or ![4] in `code [1]` and $x_[2]$ of (Doe et al., 2001).'", "''"),
    _when("doc_id % 6 = 4", _lines("'As ' || chr(92) || '[doe2001' || chr(92) || '] and ' || chr(92) || '[roe2002, doe2001' || chr(92) || '] show.'", "''")),
    _when("doc_id % 3 = 0", _lines("'```python'", "'x = [1]'", "'# not a heading'", "'```'", "''")),
    _when("doc_id % 4 = 1", _lines("'$$'", "'a = [2]'", "'$$'", "''")),
    _lines("CASE WHEN doc_id % 2 = 0 THEN '![[fig a]](images/f' || CAST(doc_id % 9 AS STRING) || '.png)' ELSE '![fig](images/f' || CAST(doc_id % 9 AS STRING) || '.png)' END", "''", "'Figure 1: Results over 10 10 trials [2].'", "''"),
    _when("doc_id % 7 = 2", _lines("'![a](a.png)'", "'![b](b.png)'", "''", "'Fig. 2. Two panels.'", "''")),
    _lines("'See Figure 1, Figs. 1 and 2, Figures 1-2 and Fig.~3; 图 1 too, not `Figure 1`.'", "''"),
    _when("doc_id % 8 = 3", _lines("'<table>'", "'<tr><td>a</td><td>b</td></tr>'", "'<tr><td>1</td><td>2</td></tr>'", "'</table>'", "''")),
    _when("doc_id % 8 = 4", _lines("'<table><tr><td colspan=\"2\">a</td></tr><tr><td>1</td><td>2</td></tr></table>'", "'</table>'", "''")),
    _lines("'| k | v |'", "'| --- | --- |'", "'| a | [[#^ref-1|¹]] |'", "''"),
    _when("doc_id % 5 = 2", _lines("'[^1]: J. Doe, A study of things. Journal of X, 2001.'", "'[^2]: a plain remark'", "'    that goes on'", "'[^3]: A. Roe, Other things. arXiv, 2003.'", "''")),
    _when("doc_id % 9 = 5", _lines("'cafÃ© au lait'", "''")),
    _lines("'- item one'", "'- item two'", "''", "'ICRA2024'", "''", "'[[#^ref-9|⁹]] and [[#fig-a|a]] and [[#fig-9|b]] <a id=\"fig-a\"></a>'", "''"),
    _when("doc_id % 10 = 6", _lines("'> English one.'", "''", "'中文一。'", "''", "'> English two.'", "''", "'中文二。'", "''", "'> English three.'", "''", "'中文三。'", "''")),
    _lines("'## References'", "''", "'[1] Smith, A. and Lee, B. Learning things. Journal of Tests, 2000.'", "''", "'[2] Doe, J. A study of'", "'longer things. arXiv 2001.'", f"'[3] Roe, R. Notes ' || {_ID} || '. 2002. ' || chr(92) || '[cs.LG' || chr(92) || ']'"),
    _lines("''", "'## Appendix'", "''"),
    _when("doc_id % 4 = 0", _lines("'More in [1].'", "''")),
    # Last, since a stray math sign in a document's own text protects all that follows.
    _lines("text"),
]

#: The Markdown text of a row of ``documents``, for both engines.
EXPRESSION = " || ".join(f"({p})" for p in _PARTS)

#: The lines of the view in DuckDB: doc_id, line_no (from 1), line, and the whole text md.
ORACLE_MD = f"md AS (SELECT doc_id, {EXPRESSION} AS md FROM documents)"
ORACLE_LINES = ORACLE_MD + ", ln AS (SELECT doc_id, md, unnest(string_split(md, chr(10))) AS line, CAST(generate_subscripts(string_split(md, chr(10)), 1) AS BIGINT) AS line_no FROM md)"


def markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text) of the view."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return docs.select("doc_id", F.expr(f"'notes/' || {_ID} || '.md'").alias("path"), F.expr(EXPRESSION).alias("text"))
