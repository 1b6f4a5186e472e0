"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether Spark removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "plumbline", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session without that setting gets a temporary folder, because there
    the driver's disk is the executors' disk.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get(CHECKPOINT_CONF, None) or conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    made = getattr(spark.sparkContext, "_plumbline_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext._plumbline_shared = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to shared storage once and go on from there.

    Lost executors then cost no recomputation. Unlike an RDD checkpoint this evaluates the plan
    a single time, and the file sizes give later joins a measured size to decide on.
    """
    return Stored(df).rows


class Stored:
    """A frame written to shared storage, as by ``cut_lineage``, until ``drop``.

    It takes the place of a cached frame where rows are many: a task that caches serialises a hundred batches before it
    lets go of the first, in memory that nobody accounts for, and many wide batches do not fit an executor.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.spark.conf.set(CLEANUP_CONF, "true")  # what is written is read from there, its shuffles never again
        self.path = scratch_path(self.spark, "stage")
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; nothing may read the rows after this."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
