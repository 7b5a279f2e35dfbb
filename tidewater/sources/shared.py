"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new folder on a local master, else an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: every later use sees the same rows. The files go when the session's file systems close."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # its shuffle files go when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Tables under a digest of what they are made from: made once, found again by later queries and after a failure."""

    def __init__(self, spark: SparkSession, name: str, digest: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{digest}"

    def has(self, table: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def table(self, table: str, make=None) -> DataFrame:
        """The table, made and written first if it is not there whole; one that a failed writer left is replaced."""
        if make is not None and not self.has(table):
            make().write.mode("overwrite").parquet(f"{self.root}/{table}")
        return self.spark.read.parquet(f"{self.root}/{table}")


def fingerprint(spark: SparkSession, paths: list[str], *more: object) -> str:
    """A digest of the files at the paths by name, length and time of change, and of what else decides a result."""
    found = []
    for path in paths:
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return md5(repr((sorted(found), more)).encode()).hexdigest()
