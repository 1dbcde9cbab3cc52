"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A ledger is a folder with, per committed batch, signed entries (one per document, version and
direction) and their rollup.  Inserts add, deletes subtract, a revised document subtracts its old
entry and adds its new one; totals are the sum of the rollups of committed batches and never
rescan documents.  A batch is written under its id and becomes visible with its commit marker,
written last; committing an id again changes nothing, and what a failed attempt left is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import textkit as tk
from lectern.llm.scratch import new_path, prepare

#: Fixed value: the pre-token pattern published with the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = "words-1"
_COUNTED = "doc_id long, source string, lang string, n_chars long, version string, tokens long, digest binary"


@dataclass(frozen=True)
class Tokenizer:
    """A version label and, for byte-level BPE, the vocabulary's text (rank file); else words."""

    version: str
    ranks: bytes | None = None

    def counter(self):
        if self.ranks is None:
            return lambda text: len(text.split())
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.ranks.splitlines() if line)}
        bpe = tiktoken.Encoding(self.version, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        return lambda text: len(bpe.encode_ordinary(text.decode("utf-8", "replace")))


def byte_bpe(path: str, version: str) -> Tokenizer:
    """A tokenizer from a rank file; read here once (about a megabyte) and sent with the tasks."""
    with open(path, "rb") as f:
        return Tokenizer(version, f.read())


_LOADED: dict[Tokenizer, object] = {}


def _count_mapper(tokenizers: tuple[Tokenizer, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tokenizers:
            if t not in _LOADED:
                _LOADED[t] = t.counter()
        counters = [(t.version, _LOADED[t]) for t in tokenizers]
        for batch in batches:
            raw, offsets = tk.column_bytes(batch.column(3))
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            data = raw.tobytes()
            for version, count in counters:
                tokens = [count(data[a:b]) for a, b in spans]
                chars = [len(data[a:b].decode("utf-8", "replace")) for a, b in spans]
                digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(chars, pa.int64()), pa.array([version] * len(tokens), pa.string()), pa.array(tokens, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "source", "lang", "n_chars", "version", "tokens", "digest"]
                )

    return run


def count_tokens(docs: DataFrame, tokenizers: tuple[Tokenizer, ...]) -> DataFrame:
    """(doc_id, source, lang, n_chars, version, tokens, digest of the text): a row per document and tokenizer."""
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(_count_mapper(tokenizers), _COUNTED)


class Ledger:
    """The rollup at ``path``; see the module's text for its promises."""

    _ENTRY = "doc_id long, source string, lang string, version string, docs long, n_chars long, tokens long"
    _ROLLUP = "source string, lang string, version string, docs long, n_chars long, tokens long"

    def __init__(self, spark: SparkSession, tokenizers: tuple[Tokenizer, ...], path: str | None = None):
        self.spark, self.tokenizers = spark, tokenizers
        prepare(spark)
        self.path = path or new_path(spark, "ledger")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        root, store = self._hadoop(f"{self.path}/committed")
        return sorted(f.getPath().getName() for f in store.listStatus(root)) if store.exists(root) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies (doc_id, source, lang, text, op); False if the batch was applied before.

        ``upsert`` counts the text and replaces what the document had; ``move`` refiles its
        counts under the given source and lang (a null one stays as it was); ``delete`` takes
        them away.  Of several changes to one doc_id an upsert goes before a move before a
        delete; of several upserts one wins by its text's digest, then source, then lang.
        Null text counts 0 tokens.  Moving or deleting an unknown document does nothing.  A null
        doc_id is a document of its own.  Texts are counted where they are read; only counts are
        shuffled.
        """
        if not batch_id or "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"batch id {batch_id!r} can't name a folder")
        if batch_id in self.committed():
            return False
        columns = ["doc_id", "source", "lang", "version"]
        sums = ["docs", "n_chars", "tokens"]
        winner = Window.partitionBy("doc_id", "version").orderBy(F.col("digest").desc(), F.col("source").desc_nulls_last(), F.col("lang").desc_nulls_last())
        counted = count_tokens(changes.where("op = 'upsert'"), self.tokenizers).withColumn("nth", F.row_number().over(winner)).where("nth = 1")
        parts = [counted.select(*columns, F.lit(1).cast("long").alias("docs"), "n_chars", "tokens")]
        if self.committed():
            upserts = changes.where("op = 'upsert'").select(F.col("doc_id").cast("long").alias("id")).distinct()
            first = Window.partitionBy("id").orderBy((F.col("op") == "move").desc(), F.col("to_source").desc_nulls_last(), F.col("to_lang").desc_nulls_last())
            others = changes.where("op IN ('move', 'delete')").select(F.col("doc_id").cast("long").alias("id"), "op", F.col("source").alias("to_source"), F.col("lang").alias("to_lang"))
            others = others.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
            others = others.join(upserts.withColumnRenamed("id", "up"), F.col("id").eqNullSafe(F.col("up")), "left_anti")
            touched = others.unionByName(upserts.select("id", F.lit("upsert").alias("op"), F.lit(None).cast("string").alias("to_source"), F.lit(None).cast("string").alias("to_lang")))
            # Entries of other documents are left out before anything is summed; Spark broadcasts the ids of a small batch.
            known = self._read("entries", self._ENTRY).join(touched.select("id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
            held = self._balances(known).join(touched, F.col("doc_id").eqNullSafe(F.col("id")))
            parts.append(held.select(*columns, *((-F.col(c)).alias(c) for c in sums)))
            parts.append(held.where("op = 'move'").select("doc_id", F.coalesce("to_source", "source").alias("source"), F.coalesce("to_lang", "lang").alias("lang"), "version", *sums))
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{self.path}/entries/{batch_id}")
        entries = self.spark.read.schema(self._ENTRY).parquet(f"{self.path}/entries/{batch_id}")
        self._sum(entries).write.mode("overwrite").parquet(f"{self.path}/rollup/{batch_id}")
        marker, store = self._hadoop(f"{self.path}/committed/{batch_id}")
        store.create(marker, False).close()
        return True

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang", "version").agg(*(F.sum(c).alias(c) for c in ("docs", "n_chars", "tokens")))

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, n_chars, tokens) over the committed batches; groups without documents are left out."""
        return self._sum(self._read("rollup", self._ROLLUP)).where("docs <> 0")

    def balances(self) -> DataFrame:
        """(doc_id, source, lang, version, docs, n_chars, tokens): what each document adds to the totals now."""
        return self._balances(self._read("entries", self._ENTRY))

    @staticmethod
    def _balances(entries: DataFrame) -> DataFrame:
        rows = entries.groupBy("doc_id", "source", "lang", "version")
        return rows.agg(*(F.sum(c).alias(c) for c in ("docs", "n_chars", "tokens"))).where("docs <> 0")
