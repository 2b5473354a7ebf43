"""What the operators share: the folder for intermediate tables, and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, UPPER, LOWER)


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; a private one is
    made only where the setting is absent and the master is local, as in tests.
    The path goes when the JVM that made it ends.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(work_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        work_dir.own = root
    path = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Drops an intermediate table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, to: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    to = to or work_dir(spark)
    df.write.mode("overwrite").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


class Scratch:
    """Intermediate tables of one call, dropped together once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, work_dir(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return written(df, f"{self.path}/{self.n}")

    def drop(self) -> None:
        remove(self.spark, self.path)
