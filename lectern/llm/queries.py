"""Driver-facing queries of this subpackage, by name, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, chat, decontaminate, fmindex, langid, minhash, mixing, oracles, suffixes, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=100))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.report(fmindex.remove_repeated_words(_table(spark, sf_dir, "documents"), length=13))


def op5_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


#: Where the public vocabularies are, on the driver; the setting ``lectern.tokenizers`` overrides it.
TOKENIZERS = "/opt/tokenizers"


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, revises those with odd white space, deletes the toxic, refiles the poor, replays a batch."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ledger = tokens.Ledger(spark, (tokens.Tokenizer(tokens.WORDS), tokens.byte_bpe(f"{spark.conf.get('lectern.tokenizers', TOKENIZERS)}/byte_bpe_50k.tiktoken", "byte_bpe_50k")))
    load = docs.select("doc_id", "source", "lang", "text", F.lit("upsert").alias("op"))
    tidy = F.regexp_replace(F.trim("text"), "  +", " ")
    revised = docs.where(tidy != F.col("text")).select("doc_id", "source", "lang", tidy.alias("text"), F.lit("upsert").alias("op"))
    nothing = F.lit(None).cast("string")
    toxic = labels.where("toxic = 1").select("doc_id", nothing.alias("source"), nothing.alias("lang"), nothing.alias("text"), F.lit("delete").alias("op"))
    poor = labels.where("quality = 0").select("doc_id", F.lit("low-quality").alias("source"), nothing.alias("lang"), nothing.alias("text"), F.lit("move").alias("op"))
    ledger.commit("load", load)
    ledger.commit("revise", revised)
    ledger.commit("load", load)
    ledger.commit("purge", toxic)
    ledger.commit("refile", poor)
    return ledger.totals()


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_multiprobe_ann": op5_multiprobe_ann,
    "op6_warc": op6_warc,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
}

#: Without a twin: op2 (a trained model), op5 (approximate), op8 (a BPE), op9 (ranked retrieval) and the pipeline.
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op3_suffix_array_dedup": oracles.REPEATED_BYTES,
    "op4_substring_dedup": oracles.REPEATED_WORDS,
    "op6_warc": oracles.WARC,
    "op7_source_mixing": mixing.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
