"""The line relation of a corpus and its region flags.

The region machine runs as one ``aggregate`` over a document's own lines, so a corpus of any
size is flagged without a shuffle; the state's history is one character per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Region codes: frontmatter, code, display math, HTML table, comment, references, prose.
FRONTMATTER, CODE, MATH, TABLE, COMMENT, REFERENCES, PROSE = "F", "C", "M", "T", "H", "R", "."
_FENCE = r"^[ \t]{0,3}(?:>[ \t]*)*(`{3,}|~{3,})"
_REFERENCE_TITLE = r"(?i)^#{1,6}\s*(?:References|Bibliography|参考文献)\s*$"


def region_codes(lines: Column) -> Column:
    """A string with one region code per line."""
    start = F.struct(F.lit("").alias("codes"), F.lit("").alias("mode"), F.lit("").alias("fence"), F.lit(0).alias("level"))

    def step(state: Column, line: Column) -> Column:
        mode, fence, level = state["mode"], state["fence"], state["level"]
        bare = F.trim(line)
        opens = F.regexp_extract(line, _FENCE, 1)
        hashes = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
        depth = F.when(line.rlike(_REFERENCE_TITLE), F.length(F.regexp_extract(line, "^(#+)", 1))).when((hashes > 0) & (hashes <= level), 0).otherwise(level)
        closes = (opens != "") & (F.substring(opens, 1, 1) == F.substring(fence, 1, 1)) & (F.length(opens) >= F.length(fence))
        first = state["codes"] == ""
        plain = mode == ""
        code = (
            F.when(~plain, mode)
            .when(first & (bare == "---"), FRONTMATTER)
            .when(opens != "", CODE)
            .when(bare == "$$", MATH)
            .when(bare.rlike("(?i)^<table"), TABLE)
            .when(bare.startswith("%%"), COMMENT)
            .when(depth > 0, REFERENCES)
            .otherwise(PROSE)
        )
        ended = (
            ((mode == FRONTMATTER) & (bare == "---"))
            | ((mode == CODE) & closes)
            | ((mode == MATH) & (bare == "$$"))
            | ((mode == TABLE) & line.rlike("(?i)</table>"))
            | ((mode == COMMENT) & line.contains("%%"))
        )
        single = ((code == TABLE) & line.rlike("(?i)</table>")) | ((code == COMMENT) & F.substring(bare, 3, 2**31 - 1).contains("%%"))
        entered = F.when(code.isin(REFERENCES, PROSE) | single, "").otherwise(code)
        return F.struct(
            F.concat(state["codes"], code).alias("codes"),
            F.when(plain, entered).when(ended, "").otherwise(mode).alias("mode"),
            F.when(plain, opens).otherwise(fence).alias("fence"),
            F.when(plain & code.isin(REFERENCES, PROSE), depth).otherwise(level).alias("level"),
        )

    def quick(state: Column, line: Column) -> Column:
        # A line that can't open or close anything leaves the state as it is.
        same = F.struct(F.concat(state["codes"], F.when(state["level"] > 0, REFERENCES).otherwise(PROSE)).alias("codes"), state["mode"].alias("mode"), state["fence"].alias("fence"), state["level"].alias("level"))
        return F.when((state["mode"] == "") & ~line.rlike(r"^\s*(?:>[ \t]*)*[`~$<%#-]"), same).otherwise(step(state, line))

    return F.aggregate(lines, start, quick, lambda s: s["codes"])


def with_regions(rows: Column, edit) -> Column:
    """``edit(line, region)`` of every line; the codes are computed once."""
    return F.zip_with(rows, F.regexp_extract_all(region_codes(rows), F.lit("."), F.lit(0)), edit)


def lines(notes: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line, region) of (doc_id, text)."""
    split = notes.select("doc_id", F.split("text", "\n", -1).alias("rows"))
    coded = split.withColumn("codes", region_codes(F.col("rows")))
    row = lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.substring(F.col("codes"), i + 1, F.lit(1)).alias("region"))
    return coded.select("doc_id", F.inline(F.transform("rows", row)))


def sections(rows: DataFrame) -> DataFrame:
    """``lines`` with the heading each line stands under (null before the first)."""
    heading = F.when(F.col("region").isin(REFERENCES, PROSE) & F.col("line").rlike(r"^#{1,6}\s+\S"), F.regexp_replace("line", r"^#{1,6}\s+|\s+$", ""))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(so_far))


def join_lines(lines_: Column) -> Column:
    return F.array_join(lines_, "\n")
