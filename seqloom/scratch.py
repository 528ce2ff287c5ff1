"""Tables in the folder that driver and executors share, sizes of broadcasts and of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow tables that may be broadcast once counted; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: A row may be a long text or a whole sequence, so Arrow batches are bounded by rows and by bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for, so that tasks and Spark write to the same place."""
    fs, where = _place(spark, path)
    full = fs.makeQualified(where).toString()
    return full if not full.startswith("file:/") or full.startswith("file://") else f"file://{full[5:]}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder that no later step reads."""
    fs, where = _place(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, computed once and read from the shared folder; ``scratch`` names its place."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        remove(df.sparkSession, df.scratch)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes from now on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for a broadcast if a count bounds it, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """A small table of fewer files than the cluster has cores, dealt over the cores; any other table as it is.

    A file with one row group is one task, however many cores wait. The size is that of the files, from the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= most_bytes and len(df.inputFiles()) < cores else df
