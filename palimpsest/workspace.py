"""Stage tables of operators with several passes, on storage that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local session without one gets its own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


class Workspace:
    """Stage tables of one run, as Parquet in the shared folder: a lost executor costs no more than the tasks it ran."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def drop(self, name: str = "") -> None:
        """Deletes a table that nothing reads any more, or all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(conf).delete(path, True)
