"""Stages of the corpus pipeline and how they are chained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, minhash, mixing, suffixes
from lectern.llm.scratch import Tables, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or far from every language; fills null languages in."""
    return langid.keep_known(docs, langid.train(docs.where(~langid.held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group (five-word shingles, 0.8); repeats of a kept row stay."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept["_kept_id"]), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every 100-byte string that starts earlier; what is left of a cut letter goes too.

    Every document stays, if only with empty text (null stays null); n_chars follows the text.
    """
    removed = suffixes.remove_repeated_bytes(docs, length=100, carry=tuple(c for c in docs.columns if c != "text"))
    rows = removed.select("carried", (F.size("starts") > 0).alias("cut"), "had_text", "kept_text")
    new = {
        "text": F.when(F.col("had_text"), F.col("kept_text")),
        "n_chars": F.when(F.col("cut"), F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars")),
    }
    return rows.select(*(new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for name, stage in STAGES[:-1]:
            docs = tables.write(stage(spark, docs, sf_dir), f"stage-{name}")
        name, stage = STAGES[-1]
        return materialize(stage(spark, docs, sf_dir), f"stage-{name}")
