"""Sinks: notes written atomically by the executors, packets as JSON lines, reports.

Transforms return DataFrames and write nothing; these are the explicit calls that do.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WRITTEN = "path string, status string, sha256 string"


def valid_note(text: Column) -> Column:
    """Whether a note may be written: 20 bytes at least, frontmatter first, a level-1 heading."""
    return (F.octet_length(text) >= 20) & text.rlike(r"\A---\r?\n") & text.rlike(r"(?m)^#\s+\S")


def write_notes(notes: DataFrame, root: str, write: bool = False, backup: str | None = None) -> DataFrame:
    """(path, status, sha256) of notes (path, text), path relative to ``root``.

    Status is written, unchanged, invalid, conflict, or would_write without ``write``.  Each file is
    written beside its target and moved into place, so a lost executor leaves the old note; a retried
    task writes the same bytes.  ``root`` is a URI that every executor reaches.

    Two optional columns guard a write: ``ready`` (a validator's judgement; a note that isn't is
    invalid) and ``base_sha256`` (what the note was made from; a file that is something else by now
    is a conflict and stays, and null means that there was no file).  With ``backup`` a file that is
    replaced stays beside it as ``<name>.bak-<backup>``.
    """
    ready = F.coalesce("ready", F.lit(False)) if "ready" in notes.columns else F.lit(True)
    guarded = "base_sha256" in notes.columns
    base_hash = F.col("base_sha256") if guarded else F.lit(None).cast("string")

    def put_whole(store: fs.FileSystem, target: str, data: bytes) -> None:
        part = f"{target}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part, compression=None) as out:
            out.write(data)
        store.move(part, target)

    rows = notes.select("path", F.col("text"), (valid_note(F.col("text")) & ready).alias("valid"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), base_hash.alias("base"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            status = []
            for path, text, valid, known in zip(batch["path"], batch["text"], batch["valid"], batch["base"], strict=True):
                target = posixpath.normpath(posixpath.join(base, path))
                if not valid or not target.startswith(base.rstrip("/") + "/"):
                    status.append("invalid")
                    continue
                data, before = text.encode(), None
                if store.get_file_info(target).type == fs.FileType.File:
                    with store.open_input_file(target) as old:
                        before = old.read()
                if before == data:
                    status.append("unchanged")
                    continue
                if guarded and known != (None if before is None else hashlib.sha256(before).hexdigest()):
                    status.append("conflict")
                    continue
                if write:
                    store.create_dir(posixpath.dirname(target), recursive=True)
                    if backup is not None and before is not None:
                        put_whole(store, f"{target}.bak-{backup}", before)
                    put_whole(store, target, data)
                status.append("written" if write else "would_write")
            yield pd.DataFrame({"path": batch["path"], "status": status, "sha256": batch["sha256"]})

    return rows.mapInPandas(put, _WRITTEN)


def write_index(entries: DataFrame, path: str, version: int) -> None:
    """Replaces the index of this version at ``path``; ``readers.read_index`` reads it, and no other version."""
    entries.write.mode("overwrite").parquet(f"{path}/schema_version={version}")


def packet_lines(units: DataFrame) -> DataFrame:
    """(doc_id, value): one compact JSON object per unit with id, type and its single payload field, for ``write.text``."""
    payload = F.col("english")
    row = F.struct(
        F.col("unit_id").alias("id"),
        F.col("kind").alias("type"),
        F.when(~F.col("kind").isin("reference", "reference_title"), payload).alias("text"),
        F.when(F.col("kind") == "reference_title", payload).alias("title"),
        F.when(F.col("kind") == "reference", payload).alias("entry"),
    )
    return units.select("doc_id", F.to_json(row).alias("value"))


def compact_report(findings: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, n_errors, n_warnings, errors, warnings): counts, and the first messages up to ``most`` of each kind."""
    told = F.concat_ws(": ", "rule", "detail")
    pick = lambda s: F.slice(F.sort_array(F.collect_list(F.when(F.col("severity") == s, told))), 1, most)
    return findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), pick("error").alias("errors"), pick("warning").alias("warnings"))


def files_to_remove(listing: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files of a finished workflow that no evidence list (path) names."""
    return listing.join(evidence.select("path"), "path", "left_anti")
