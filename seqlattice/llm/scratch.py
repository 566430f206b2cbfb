"""Tables written to the folder that every executor can read, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import at_exit


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only where none is set on a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_open: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear() -> None:
    """Deletes all scratch tables of this driver; call it once results are stored. It also runs when the driver ends."""
    for root, spark in list(_open.items()):
        _delete(spark, root)
        del _open[root]


class Scratch:
    """Names tables under one folder of the shared checkpoint root and can drop those no longer needed.

    What a result still reads stays until clear() or the end of the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        if not _open:
            at_exit(clear)
        _open[self.root] = spark

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back: its lineage ends here, and lost executors cost no recomputation."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)
