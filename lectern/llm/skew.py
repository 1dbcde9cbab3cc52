"""Joins on keys of which one may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so there are at most SHARES of them.
SHARES = 2048
#: Parts that a hot key's rows are dealt to.
PARTS = 64


def spread_join(left: DataFrame, right: DataFrame, weights: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key; hot keys of ``left`` are dealt to ``PARTS`` tasks.

    ``weights`` (key, weight) is a written table with the left rows of each key.  The hot keys, at
    most ``SHARES`` of them, are named in the plan; their rows on the right are repeated for every
    part.  ``by`` is a column of ``left`` that spreads the rows of one key.  ``how`` is inner, left or left_semi.
    """
    total = weights.agg(F.sum("weight").alias("n")).first()["n"] or 0
    hot = [r[0] for r in weights.where(F.col("weight") > total // SHARES + 1).select(key).limit(SHARES).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    dealt = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(0))
    parts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(right.withColumn("_part", F.explode(parts)), [key, "_part"], how).drop("_part")


def weigh(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("weight"))
