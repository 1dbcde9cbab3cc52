"""The corpus pipeline: language ID, near-dedup, repeated passages, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.pipeline import STAGES, run_stages

#: The language, MinHash and sampling stages have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
