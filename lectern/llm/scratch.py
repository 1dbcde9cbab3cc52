"""Durable intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs a re-read and never a recomputation of an iterative plan.  ``Tables`` deletes
what an operator no longer needs; shuffle files go when the query that wrote them ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = "lectern-scratch"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a temporary one is chosen where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_ROOT}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    return _written(df, new_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    prepare(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Intermediate tables of one operator's call; those still there go when the ``with`` block ends."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self._spark, label)
        table = _written(df, path)
        self._paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self._spark, self._paths.pop(id(table))[0])

    def __exit__(self, *_: object) -> None:
        for path, _table in self._paths.values():
            _delete(self._spark, path)
        self._paths.clear()


def purge(spark: SparkSession) -> None:
    """Delete this application's intermediate tables (after results have been consumed)."""
    _delete(spark, f"{shared_dir(spark)}/{_ROOT}/{spark.sparkContext.applicationId}")


#: Rows of an Arrow batch, where the session leaves Spark's default: texts can be long.
BATCH_ROWS = 1000
_DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
}


def prepare(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches and the life of shuffle files where the session leaves Spark's defaults."""
    for key, (default, ours) in _DEFAULTS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
