"""Session helpers: a tuned builder, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: str | None = None


def build_session(app: str = "tracebed", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``; only on one machine (a local master), where that is unset, a folder of our own."""
    global _OWN_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_ROOT is None:
        _OWN_ROOT = tempfile.mkdtemp(prefix="tracebed-")
    return f"file://{_OWN_ROOT}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; scratch then stays for the folder's owner
        pass


class Scratch:
    """Named tables written to the shared folder, so that later steps read them instead of recomputing.

    A written table outlives any executor, unlike blocks kept on one machine. ``keep`` writes and reads back,
    ``drop`` deletes a table that nothing will read again (the previous round of a loop).
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tracebed-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str = "t", *partition_by: str) -> str:
        self._n += 1
        path = self.path(f"{self._n:04d}-{name}")
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def drop(self, df: DataFrame) -> None:
        for path in df.inputFiles()[:1]:
            if self.root.removeprefix("file:").lstrip("/") in path:
                _delete(self.spark, os.path.dirname(path))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package's source to the Python workers, once for each application: they may not have it on their path."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="tracebed-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
