"""What Python workers need to know of the driver, and tables kept in the shared folder between jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it; on a cluster, deploy it there or in a zip by ``--py-files``."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files make fewer partitions than that; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_written: dict[str, SparkSession] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _delete(paths: list[str]) -> None:
    for path in paths:
        if path in _written:
            spark = _written.pop(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear() -> None:
    """Deletes what this driver stored; call it once results are kept elsewhere. It also runs when the driver ends."""
    _delete(list(_written))


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end what this thread stored inside, for work that repeats as long as the driver runs."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(paths)


def at_exit(clear: Callable[[], None]) -> None:
    """Runs ``clear`` when the driver ends, unless the JVM has gone before."""

    def run() -> None:
        with contextlib.suppress(Py4JError, OSError):
            clear()

    atexit.register(run)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, deleted by clear().

    The folder is the cluster's spark.checkpoint.dir; only on a local master
    without one is it a fresh local folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    if not _written:
        at_exit(clear)
    _written[path] = spark
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    return path


def stored(df: DataFrame, deal: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, to cut lineage between iterations.

    With ``deal``, a table so small that it lies in fewer files than there are
    cores is dealt over all of them, for heavy work on each row.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return stored(spread(out)) if deal and out.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else out
