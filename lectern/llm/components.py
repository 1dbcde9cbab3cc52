"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import Tables, materialize
from lectern.llm.skew import spread_join


def _large_star(edges: DataFrame, tables: Tables) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = tables.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("weight")), "least")
    joined = spread_join(both.where("v > u"), low.select("u", F.least("u", "m").alias("m")), low, "u", "v")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, tables: Tables) -> DataFrame:
    low = tables.write(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("weight")), "least")
    joined = spread_join(edges, low.select("u", "m"), low, "u", "v")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60, keep: Tables | None = None) -> DataFrame:
    """(u long, v long) -> (node, component): each linked node but the roots, with the least node it reaches.

    Nodes absent from the result are their own component. Nothing but two yes-or-no answers per round
    reaches the driver; the number of rounds grows with the logarithm of the longest path.
    Self-loops and null ends are ignored; repeated edges are harmless.  A node with very many links
    is dealt to several tasks.
    """
    with Tables(edges.sparkSession) as tables:
        edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = tables.write(edges, "edges")
        for _ in range(max_rounds):
            # A star forest has one parent per node and no parent that is itself a child.
            parents = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi")
            if parents.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
                return (keep.write if keep else materialize)(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
            large = tables.write(_large_star(edges, tables).distinct(), "edges")
            tables.drop(edges)
            edges = tables.write(_small_star(large, tables).distinct(), "edges")
            tables.drop(large)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
