"""Tables written once to a shared folder and read again: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is open in this thread of control, if any.
_open_run: ContextVar[str | None] = ContextVar("open_run", default=None)


def _root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new temporary one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Where tables are staged: the folder of the open `run`, else the shared folder itself."""
    return _open_run.get() or _root(spark)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Everything staged inside goes to one folder, deleted at the end: write the result before that. Runs
    may be nested, and runs of several threads don't see each other."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _open_run.set(folder)
    try:
        yield folder
    finally:
        _open_run.reset(token)
        delete(spark, folder)


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """staged(build()); what was staged on the way is deleted, as nothing reads it any more."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with run(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A staged table of narrow rows, marked for broadcast up to most_rows; beyond, joins with it are shuffled."""
    from pyspark.sql.functions import broadcast

    return broadcast(df) if df.count() <= most_rows else df


#: Scans of at most this many bytes count as small.
SMALL_SCAN = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """For dear expressions over a scan: a scan of few bytes, which has all its rows in one or two splits, is dealt
    evenly to the cores; a larger one has splits enough and stays as it is, whatever the number of cores."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_SCAN:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
