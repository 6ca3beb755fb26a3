"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and a modest shuffle width for local work."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quillspark")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without it; it then gets a temporary folder of its own. On a
    cluster a missing setting is an error, because a machine-local folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written once to the shared folder, so that lineage is cut and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # results read these tables lazily, so they stay as long as the driver

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back with the same schema."""
        path = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd").options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete one table that nothing lazy reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
