"""A table kept in buckets of its key: a batch rewrites the buckets that it touches, once."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .reconcile import upsert


class Snapshot:
    """Rows by key at ``path``, in ``buckets`` partitions by a hash of the key columns, and the ids of the batches that are in them.

    A batch is merged with the rows of the buckets that its keys fall in: no other is read or written. The new rows are staged first and then
    take the buckets' place; the batch's id is recorded last. A batch that is applied again is known by it and does nothing. One that was cut
    off before its record is applied again, which gives the same rows, as merges by key do. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        rows.where(F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/schema")  # what an empty table is read by
        rows.withColumn("__bucket", self.bucket()).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/rows")
        self.spark.createDataFrame([], "batch string, buckets array<int>").write.mode("overwrite").parquet(f"{self.path}/batches")

    def rows(self) -> DataFrame:
        return self._read().drop("__bucket")

    def batches(self) -> DataFrame:
        """(batch, buckets): what was applied."""
        return self.spark.read.schema("batch string, buckets array<int>").parquet(f"{self.path}/batches")

    def _read(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema.add("__bucket", "integer")).parquet(f"{self.path}/rows")

    def apply(self, batch: DataFrame, batch_id: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """The buckets rewritten: none if the batch was applied before. ``merge`` maps (stored rows, batch) to the rows of the next
        state, each within its key's bucket; by default the batch's rows replace those of their keys."""
        if self.batches().where(F.col("batch") == batch_id).limit(1).count():
            return []
        work = Workspace(self.spark, "snapshot")
        batch = work.save(batch.withColumn("__bucket", self.bucket()), "batch")
        touched = sorted(r[0] for r in batch.select("__bucket").distinct().collect())  # at most ``buckets``
        merge = merge or partial(upsert, keys=self.keys)
        old = self._read()
        new = merge(old.where(F.col("__bucket").isin(touched)).drop("__bucket"), batch.drop("__bucket"))
        staged = work.save(new.select(*[c for c in old.columns if c != "__bucket"]).withColumn("__bucket", self.bucket()), "rows")
        left = {r[0] for r in staged.select("__bucket").distinct().collect()}
        if not left <= set(touched):
            raise ValueError("a merge may not move rows to other keys")
        staged.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{self.path}/rows")
        for b in set(touched) - left:  # nothing is written for an empty bucket
            self._delete(f"{self.path}/rows/__bucket={b}")
        self.spark.createDataFrame([(batch_id, touched)], "batch string, buckets array<int>").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        work.drop()
        return touched

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
