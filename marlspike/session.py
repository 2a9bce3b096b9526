"""Session factory and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library relies on; the cluster's own values win where they are set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_own_dir: str | None = None


def build_session(app: str = "marlspike", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without it, a temporary one of this process.

    On a cluster the setting must be there: a driver's own folder means nothing
    to an executor, so its absence is an error.
    """
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="marlspike-")
    return _own_dir


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, empty folder that all executors share. It is deleted when the application ends."""
    path = f"{_root(spark)}/marlspike-{label}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_dir`` that nothing reads any more, before the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, label)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
