"""Mixing sources to target weights by capped water-filling, with seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import materialize

#: A source's weight by its place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Hexadecimal digits of a document's draw that pick its histogram cell, per level.
_CELL = 3


def word_count(text: F.Column) -> F.Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: float = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): capped water-filling.

    All sources share the sum of all sizes by weight.  A source's target stops at ``epochs``
    times its size; what it gives up is shared among the others by weight until none is above.
    In order of cap / weight the capped sources are a prefix: the level of the rest is the
    unassigned total over their weight, and the prefix ends where the next cap reaches it.
    The table has a row per source; the two orderings run over it alone.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    table = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.select("source", "source_size", F.element_at(table, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = in_order.rowsBetween(0, Window.unboundedFollowing)
    spare = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = spare / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levelled.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final).alias("target"))


def mix(docs: DataFrame, epochs: float = 3, weights: tuple[int, ...] = WEIGHTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes.

    A source's target is e = target / source_size epochs.  Every document is taken floor(e) times
    whole; the rest of the target, less than one epoch, goes to documents in the order of a seeded
    hash of their id, each whole, and the last for what is still wanted.  A source's taken words
    thus equal its target rounded down, and no document exceeds ceil(epochs) times its size.

    The cut in that order is found without sorting a source: sums over 4096 cells of the hash,
    then over 4096 cells within the cell where the cut falls; only that last cell is ordered.
    Sources are ordered by code point, null last and a source of its own.  Null or blank text has
    size 0 and is taken 0 times.  Rows repeated under one id share a draw and are ordered by size;
    exact repeats among them are interchangeable.  A null id draws as the text "null".  Other
    columns are ignored; an empty table gives an empty result.  Reruns agree.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw"))
    sized = materialize(sized.withColumns({"cell": F.substring("draw", 1, _CELL), "sub": F.substring("draw", 1 + _CELL, _CELL)}), "sizes")
    by_source = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, weights), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = by_source.select("source", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("extra", F.floor(F.col("target") + F.lit(1e-6)).cast("long") - F.col("whole") * F.col("source_size"))

    def cut(cells: DataFrame, by: list[str], name: str) -> DataFrame:
        """The cells of ``name`` where the running size first reaches ``extra``, and what precedes them."""
        total = F.sum("in_cell").over(Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
        run = cells.withColumn("through", total)
        return run.where((F.col("through") > F.col("extra")) & (F.col("through") - F.col("in_cell") <= F.col("extra"))).withColumn("ahead", F.col("through") - F.col("in_cell"))

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    cells = cells.join(plan.select(F.col("source").alias("s"), "extra"), same("source", "s"))
    first = cut(cells, ["source"], "cell").select(F.col("source").alias("s1"), F.col("cell").alias("cut1"), (F.col("extra") - F.col("ahead")).alias("extra"))
    subs = sized.join(first, same("source", "s1") & (F.col("cell") == F.col("cut1")))
    subs = subs.groupBy("source", "cut1", "extra", "sub").agg(F.sum("size").alias("in_cell"))
    second = cut(subs, ["source"], "sub").select(F.col("source").alias("s2"), "cut1", F.col("sub").alias("cut2"), (F.col("extra") - F.col("ahead")).alias("left"))
    second = materialize(second, "cuts")

    wide = sized.join(plan.withColumnRenamed("source", "s"), same("source", "s")).join(second, same("source", "s2"), "left")
    prefix = F.substring("draw", 1, 2 * _CELL)
    at = F.concat("cut1", "cut2")
    # No cut means that the extra words take in the whole source (then it is a whole epoch) or nothing.
    clear = wide.where(F.col("cut1").isNull() | (prefix != at)).withColumn("part", F.when(prefix < at, F.col("size")).otherwise(F.lit(0)))
    edge = wide.where(prefix == at)
    through = F.sum("size").over(Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - through + F.col("size"))))
    return clear.unionByName(edge).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('0:', CAST(doc_id AS VARCHAR))) AS draw FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM src),
lev AS (SELECT *, ((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
first_open AS (SELECT level FROM lev WHERE cap > weight * level ORDER BY cap / weight, source LIMIT 1),
tgt AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * (SELECT level FROM first_open) END AS target FROM lev),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tgt),
plan2 AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) - whole * source_size AS extra FROM plan),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM sized)
SELECT o.doc_id, o.size, p.source_size, p.target, CAST(p.whole * o.size + greatest(0, least(o.size, p.extra - o.through + o.size)) AS BIGINT) AS taken
FROM ordered o JOIN plan2 p ON o.source IS NOT DISTINCT FROM p.source
"""
