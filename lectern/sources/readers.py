"""Scans: notes, JSON artefacts, logs, bibliography databases.  All keep projection and filters in the plan."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directories of a vault that hold no notes.
EXCLUDED = (".git", ".obsidian", ".tmp", ".trash", "node_modules", "__pycache__", "backups", "temp")

BIBLIOGRAPHY = {
    "items": "itemID long, key string",
    "itemData": "itemID long, fieldID long, valueID long",
    "itemDataValues": "valueID long, value string",
    "fields": "fieldID long, fieldName string",
    "deletedItems": "itemID long",
    "itemAttachments": "itemID long, parentItemID long, linkMode int, contentType string, path string",
}
MANIFEST = "schema_version int, artifacts struct<asset_map:string,assets_dir:string,source_pdf:string,markdown:string>, integrity struct<source_file_sha256:string,assets:array<struct<path:string,sha256:string>>>, producer struct<parse_options_fingerprint:string>"
ROLLOUT = "timestamp string, type string, payload struct<type:string,role:string,path:string,parent:string,model:string,effort:string,text:string,last_agent_message:string>"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a few small files dealt to all cores by ``key``; other tables as they are read.

    A file within one split is often one row group, which a single task reads and works on.  Less
    than half the cores' number of such files is dealt out, so that never more than half a split
    per core is moved.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * split // 2:
        return rows
    files = len(rows.inputFiles())
    return rows.repartition(cores, key) if 2 * files < cores and size <= files * split else rows


def read_notes(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, text, mtime, size) of the Markdown files below ``root``, decoded strictly as UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    below = F.filter(F.split(F.replace("path", F.lit(root.rstrip("/") + "/")), "/"), lambda p: p.isin(*excluded))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.where(F.size(below) == 0).select("path", text.alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def list_notes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text, mtime, size) of the given files, each once; only ``.md`` is accepted."""
    wrong = [p for p in paths if not p.endswith(".md")]
    if wrong:
        raise ValueError(f"not Markdown: {wrong[:3]}")
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def read_json_documents(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] | None = None) -> DataFrame:
    """(path, doc): whole-file JSON objects; files that don't parse or have another schema_version are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("doc"))
    rows = files.where("doc IS NOT NULL")
    return rows if versions is None else rows.where(F.col("doc.schema_version").isin(*versions))


def read_cache(spark: SparkSession, path: str, value: str, version: int) -> DataFrame:
    """(key, value) of the ``entries`` of versioned JSON caches at ``path``; ``value`` is an entry's schema.

    A cache is only a shortcut: one that is absent, unreadable or of another version is empty.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        return spark.createDataFrame([], f"key string, value {value}")
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema_version int, entries map<string,{value}>").alias("doc"))
    return files.where(F.col("doc.schema_version") == version).select(F.explode("doc.entries").alias("key", "value"))


def read_index(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """The rows that ``sinks.write_index`` left at ``path``; none if there are none of this version."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/schema_version={version}/_SUCCESS")
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/schema_version={version}")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): parsed JSON lines, and (path, value) of lines that aren't objects of the schema; blanks are skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), "value")
    parsed = raw.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("row IS NOT NULL AND row._bad IS NULL AND ltrim(value) LIKE '{%'").select("row.*").drop("_bad")
    return good, parsed.where("row IS NULL OR row._bad IS NOT NULL OR ltrim(value) NOT LIKE '{%'").select("path", "value")


def read_bibliography(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six relations of a bibliography database, from a snapshot that SQLite itself makes.

    A personal database is small; it is read on the driver and distributed as DataFrames.
    """
    source = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    snapshot = sqlite3.connect(":memory:")
    source.backup(snapshot)
    source.close()
    out = {}
    for table, schema in BIBLIOGRAPHY.items():
        columns = ", ".join(c.split()[0] for c in schema.split(", "))
        out[table] = spark.createDataFrame(snapshot.execute(f"SELECT {columns} FROM {table}").fetchall(), schema)
    snapshot.close()
    return out


def layout_sources(files: DataFrame, patterns: tuple[str, ...] = ("_content_list.json", "_middle.json", "_model.json", "layout.json")) -> DataFrame:
    """(note, path, priority): each layout file of (note, path) once, by the first pattern it matches."""
    rank = F.coalesce(*(F.when(F.col("path").endswith(p) & ~F.col("path").endswith("_v2.json"), F.lit(i)) for i, p in enumerate(patterns)))
    return files.withColumn("priority", rank).where("priority IS NOT NULL").dropDuplicates(["note", "path"])


def first_existing(wanted: DataFrame, candidates: list[Column], files: DataFrame) -> DataFrame:
    """``wanted`` with ``resolved``: the first of the candidate paths that ``files`` (path) lists."""
    # The candidates themselves are the key: a row's answer depends on nothing else.
    tried = wanted.withColumn("_try", F.array(*candidates))
    hits = tried.select("_try").distinct().select("_try", F.posexplode("_try").alias("at", "path")).join(files.select("path").distinct(), "path")
    return tried.join(hits.groupBy("_try").agg(F.min_by("path", "at").alias("resolved")), "_try", "left").drop("_try")


_CSL = "id string, title string, `container-title` string, publisher string, DOI string, URL string, author array<struct<family:string,given:string,literal:string>>, issued struct<`date-parts`:array<array<string>>>"


def read_csl(spark: SparkSession, path: str) -> DataFrame:
    """(key, item) of bibliography files in CSL JSON (lists of items), as ``citations.format_csl`` takes them.

    A key that stands twice, or a file that isn't such a list, is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _CSL.split(', '))}>>").alias("items"))
    wrong = [r["path"] for r in files.where("items IS NULL").select("path").limit(20).collect()]
    if wrong:
        raise ValueError(f"not a list of CSL items: {wrong}")
    rows = files.select(F.inline("items"))
    item = F.struct("title", F.col("`container-title`").alias("container_title"), "publisher", "DOI", "URL", "author", F.struct(F.col("issued.`date-parts`").alias("date_parts")).alias("issued"))
    keyed = rows.select(F.col("id").alias("key"), item.alias("item"))
    twice = [r["key"] for r in keyed.groupBy("key").count().where("count > 1 OR key IS NULL").orderBy("key").limit(20).collect()]
    if twice:
        raise ValueError(f"keys that are missing or stand more than once: {twice}")
    return keyed


def rollout_summary(events: DataFrame) -> DataFrame:
    """(path, role, parent, model, effort, message, consistent): the last meta, context and completion of each log.

    ``events`` has (path, line_no, type, payload); consistent means one assistant message, equal to
    the completion's text.
    """
    last = lambda kind: F.max_by("payload", F.when(F.col("type") == kind, F.col("line_no")))
    said = (F.col("type") == "response_item") & (F.col("payload.role") == "assistant")
    per = events.groupBy("path").agg(last("session_meta").alias("meta"), last("turn_context").alias("context"), last("event_msg").alias("done"), F.count_if(said).alias("n"), F.max(F.when(said, F.col("payload.text"))).alias("message"))
    return per.select("path", "meta.role", "meta.parent", "context.model", "context.effort", "message", ((F.col("n") == 1) & (F.col("message") == F.col("done.last_agent_message"))).alias("consistent"))


_CHILDREN = ("content", "children", "para_blocks", "blocks", "lines", "spans")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of each JSON tree, to its end and without recursion, a document at a time."""
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = json.loads(text) if text is not None else None
            left = list(enumerate(root))[::-1] if isinstance(root, list) else [(None, root)]
            pages, nodes = [], []
            while left:
                page, value = left.pop()
                if isinstance(value, list):
                    left += [(page, v) for v in reversed(value)]
                elif isinstance(value, dict):
                    pages.append(page)
                    nodes.append(json.dumps(value, ensure_ascii=False))
                    left += [(page, value[k]) for k in reversed(_CHILDREN) if k in value]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(nodes), pa.int64()), pa.array(pages, pa.int32()), pa.array(nodes, pa.string())], names=["doc_id", "page", "node"])


def flatten_layout(layouts: DataFrame) -> DataFrame:
    """(doc_id, page, node) of JSON layout trees: every object at any depth, with the page of its place in the root list.

    Children, an object or lists of any depth, hang under ``content``, ``children``, ``para_blocks``,
    ``blocks``, ``lines`` or ``spans``.  The page of a root object is null.
    """
    found = layouts.select(F.col("doc_id").cast("long"), "json").mapInArrow(_walk, "doc_id long, page int, node string")
    return found.select("doc_id", "page", F.parse_json("node").alias("node"))


def newest(files: DataFrame, by: list[str]) -> DataFrame:
    """The newest row per key, by mtime and then path."""
    order = Window.partitionBy(*by).orderBy(F.col("mtime").desc(), F.col("path").desc())
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
