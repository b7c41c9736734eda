"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kerbsight", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        # window state of streams lives on disk, not in the executors' heaps
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``, or else the one
    set on the context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one run, written as Parquet under the shared folder.

    A written table cuts lineage, survives the loss of any executor and can be read by
    column, unlike an in-memory cache.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or checkpoint_root(spark)}/run-{uuid.uuid4().hex}"
        self._written = 0
        if root and not spark.sparkContext.getCheckpointDir():
            # iterative trainers cut their lineage in the context's folder
            spark.sparkContext.setCheckpointDir(f"{root}/checkpoints")

    def path(self, name: str) -> str:
        self._written += 1
        return f"{self.root}/{self._written:04d}-{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        return self.save_at(self.path(name), df)

    def save_at(self, path: str, df: DataFrame) -> DataFrame:
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Delete one of the run's tables."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def used(self) -> bool:
        """Whether any table has been given a place."""
        return self._written > 0

    def exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def close(self) -> None:
        """Delete the run's tables; frames built on them can no longer be read."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
