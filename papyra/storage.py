"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder used where the session names none and runs in one process (local tests).
LOCAL_SHARED = "/tmp/checkpoints/papyra"

#: Applications whose folder is deleted when they end.
_ENDING: set[str] = set()

#: Held while a table is staged: shuffle files of the execution are deleted when it ends, and Python gets few texts at once.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def folder(spark: SparkSession, path: str):
    """A path for Spark's own file system calls, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that ``spark.checkpoint.dir`` names, deleted when the application ends.

    Without that setting a session of one process writes to a local folder; on a
    cluster executors would not see each other's files there, so it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = LOCAL_SHARED
    app = spark.sparkContext.applicationId
    path = f"{top.rstrip('/')}/papyra/{app}"
    if app not in _ENDING:
        at, fs = folder(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _ENDING.add(app)
    return path


#: Input below which rows are dealt out before work that is heavy for its bytes.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores: its file may be one row group, so one task. A larger input stays where it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with a table that survives lost executors. The shuffle files
    behind it are of no more use once it is written, so Spark is told to delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        at, fs = folder(df.sparkSession, df.staged_path)
        fs.delete(at, True)
