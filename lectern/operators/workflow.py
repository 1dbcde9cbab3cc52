"""Workflow state as append-only events: stages, attempts, incremental work, migration totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a log says, in small letters, where the network failed.
NETWORK = ("ws401", "websocket", "connection reset", "connection closed", "connection aborted", "https connection", "error sending request", "failed to send request", "unexpected eof", "transport error")


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def stage_durations(events: DataFrame) -> DataFrame:
    """(workflow_id, stage, started_at, finished_at, duration_ms): each stage's last run, by its events."""
    runs = events.groupBy("workflow_id", "stage").agg(F.max(F.when(F.col("status") == "started", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status") == "finished", F.col("ts"))).alias("finished_at"))
    return runs.withColumn("duration_ms", _millis("finished_at") - _millis("started_at"))


def current_state(events: DataFrame) -> DataFrame:
    """(workflow_id, stage, status, ts, n_events): the last event of each stage."""
    return events.groupBy("workflow_id", "stage").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_events"))


def number_attempts(events: DataFrame) -> DataFrame:
    """Events with ``attempt``, counting from 1 per workflow and stage, and ``gap_ms`` since the one before."""
    order = Window.partitionBy("workflow_id", "stage").orderBy("ts", "event_id")
    return events.withColumns({"attempt": F.row_number().over(order).cast("long"), "gap_ms": _millis("ts") - F.lag(_millis("ts")).over(order)})


def classify_failure(timed_out: Column, exit_code: Column, verified: Column, log: Column, contract_errors: Column, unit_errors: Column) -> Column:
    """(stage, failure, retryable) of a failed run, by its first symptom; the two last are counts.

    Only a run by something other than what was asked for isn't worth another try.
    """
    crashed = exit_code != 0
    told = F.lower(F.coalesce(log, F.lit("")))
    network = F.exists(F.array(*(F.lit(m) for m in NETWORK)), lambda m: told.contains(m))
    failure = (
        F.when(timed_out, "timeout")
        .when(crashed & network, "network_transport")
        .when(crashed, "worker_process")
        .when(~verified, "runtime_mismatch")
        .when(contract_errors > 0, "output_contract")
        .when(unit_errors > 0, "unit_validation")
        .otherwise("unknown")
    )
    stage = F.when(failure == "runtime_mismatch", "runtime_attestation").when(failure.isin("timeout", "network_transport", "worker_process"), "worker_process").otherwise("output_validation")
    return F.struct(stage.alias("stage"), failure.alias("failure"), (failure != "runtime_mismatch").alias("retryable"))


def should_retry(retryable: Column, attempts: Column, most: int = 2) -> Column:
    return retryable & (attempts < most)


def changed_since(listing: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, stale): index rows whose (path, mtime_ns, size) still holds, and files to read again."""
    key = ["path", "mtime_ns", "size"]
    return index.join(listing.select(*key), key, "left_semi"), listing.join(index.select(*key), key, "left_anti")


def fingerprint_hits(requests: DataFrame, cache: DataFrame, outputs: DataFrame) -> DataFrame:
    """``requests`` with ``hit``: the cache knows the fingerprint and the output still has the recorded hash."""
    held = cache.join(outputs.select("output", F.col("sha256").alias("now")), "output", "left").where("sha256 = now")
    return requests.join(held.select("fingerprint", F.lit(True).alias("hit")).distinct(), "fingerprint", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def frozen_errors(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(workflow_id, artifact, problem): artifacts whose recorded hash is missing or differs now."""
    both = recorded.join(current.withColumnRenamed("sha256", "now"), ["workflow_id", "artifact"], "left")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("workflow_id", "artifact", "problem")


def runtime_errors(requested: DataFrame, actual: DataFrame) -> DataFrame:
    """(run_id, field): where the actual role, path, parent, model or effort differs from the request."""
    fields = ("role", "path", "parent", "model", "effort")
    both = requested.alias("r").join(actual.alias("a"), "run_id", "left")
    wrong = F.filter(F.array(*(F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    return both.select("run_id", F.explode(wrong).alias("field"))


def migration_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (notes_scanned, notes_changed, chars_added) of a rewrite of (doc_id, text)."""
    both = before.select("doc_id", F.col("text").alias("old")).join(after.select("doc_id", F.col("text").alias("new")), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("notes_scanned"), F.count_if(F.col("old") != F.col("new")).alias("notes_changed"), F.coalesce(F.sum(F.length("new") - F.length("old")), F.lit(0)).cast("long").alias("chars_added"))


def retention(files: DataFrame, keep: int = 2) -> DataFrame:
    """Backup files to delete: all but the newest ``keep`` per (name, label), by mtime and then name."""
    order = Window.partitionBy("name", "label").orderBy(F.col("mtime").desc(), F.col("file").desc())
    return files.withColumn("nth", F.row_number().over(order)).where(F.col("nth") > keep).drop("nth")
