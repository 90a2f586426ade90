"""Tables and folders that driver and executors share, for what must be written on the way to a result."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while tables are written: long texts make the usual 10,000 many megabytes.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode (tests) where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='leafline-')}")
        root = _own[0]
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes with what is written there when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs within: each task holds a batch several times, in the JVM and in Python."""
    before = int(spark.conf.get(BATCH_CONF))
    spark.conf.set(BATCH_CONF, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, str(before))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage once, survives lost executors.

    The path is kept on the returned frame as `written_at` for `forget`.
    """
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(f"{path}/rows")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    out.written_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once no later step reads them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
