"""Chat rendering of logged conversations after collapsing cumulative snapshots.

Loggers often store a conversation again after every turn.  A rolling hash of each turn prefix
(sums of position-salted turn hashes, so prefix equality is sum equality) finds conversations
that are prefixes of longer ones; an anti-join keeps the maximal ones, equal ones keep the least
conv_id, and only those are rendered.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import materialize

#: Fixed values of the rendering format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> F.Column:
    parts = [F.lit(seed), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts).cast("decimal(20,0)")


def _escaped(text: F.Column) -> F.Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, rendered): conversations that no longer one continues, as chat text.

    Turns go by turn number (null last), then role and text; repeated turns stay and count.  A
    conversation goes if another has all its turns as its first ones and more, or has the same
    turns and a smaller conv_id.  Null roles and texts differ from empty ones when compared and
    are rendered as empty; markers inside texts and roles are spaced out, and a line break in a
    role becomes a blank.  Turns with a null conv_id make up
    one conversation, which ranks after equal ones that have an id.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hashed = placed.withColumns({"a": _turn_hash(1), "b": _turn_hash(2)})
    hashed = hashed.select("conv_id", "pos", F.max("pos").over(whole).alias("n_turns"), F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    hashed = materialize(hashed, "turn-prefixes")
    prefixes = hashed.where("pos < n_turns").select("pos", "a", "b").distinct()
    finals = hashed.where("pos = n_turns").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    kept = finals.join(prefixes, ["pos", "a", "b"], "left_anti").select(F.col("conv_id").alias("kept_id"))
    rendered = F.concat(F.lit(OPEN), _escaped(F.replace(F.col("role"), F.lit("\n"), F.lit(" "))), F.lit("\n"), _escaped(F.col("text")), F.lit(CLOSE + "\n"))
    lines = placed.join(kept, placed.conv_id.eqNullSafe(kept.kept_id), "left_semi").select("conv_id", "pos", rendered.alias("line"))
    grouped = lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
p AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
      string_agg(CASE WHEN role IS NULL THEN 'n' ELSE 'r' || role END || chr(1) || CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END || chr(2), '')
        OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
final AS (SELECT prefix, n, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY prefix, n),
kept AS (SELECT conv_id FROM final f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = f.n AND p.prefix = f.prefix))
SELECT t.conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(replace(replace(coalesce(role, ''), chr(10), ' '), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id
"""
