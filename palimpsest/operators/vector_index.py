"""Exact nearest neighbours that read a part of the vectors: clusters with a radius, written as partitions.

By the triangle inequality no vector of a cluster is nearer to a query than the cluster's center less its radius. Clusters whose bound is
beyond the k-th distance found so far aren't read: the filter on the partition column leaves their files out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import knn

#: Clusters at most, and bytes of all centers together; files of a cluster.
CLUSTERS, CENTER_BYTES, FILES = 1024, 32_000_000, 8
_ZERO = -1  # the cluster of vectors without a direction
_ROOM = 1e-6


def _points(x: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors lie: cosines are distances of unit vectors."""
    if metric == "euclidean":
        return x
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


@dataclass(frozen=True)
class VectorIndex:
    """The index at ``path``; ``centers`` has a row for each of ``clusters``, with the largest distance of its vectors and their number."""

    spark: SparkSession
    path: str
    metric: str
    clusters: list[int]
    centers: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    schema: str

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def bounds(self, query: list[float]) -> np.ndarray:
        """The least distance that a vector of each cluster may have."""
        q = _points(np.array([query], float), self.metric)[0]
        away = np.sqrt(((self.centers - q) ** 2).sum(1))
        bound = np.maximum(0, away - self.radius)
        zero = np.array([c == _ZERO for c in self.clusters], bool)
        if self.metric != "euclidean":
            bound[zero] = math.sqrt(2)  # their cosine is 0
        return bound

    def nearest(self, query: list[float], k: int, where: Column | None = None, least: float | None = None) -> DataFrame:
        """(all columns, score) as ``search.knn`` gives them, exactly: from the clusters nearest to the query that hold k vectors, then from
        those whose bound isn't beyond the k-th of these. ``where`` counts before the ranking, as there."""
        bound = self.bounds(query)
        if self.metric != "euclidean" and not any(query):
            return self._scan(self.clusters, query, k, where, least)
        order = np.argsort(bound, kind="stable")
        some = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1]
        first = self._scan([self.clusters[i] for i in some], query, k, where, least).select("score").collect()  # k rows at most
        far = math.inf
        if len(first) == k:
            worst = min(r["score"] for r in first)
            far = -worst if self.metric == "euclidean" else math.sqrt(max(0, 2 - 2 * worst))
        if least is not None:
            far = min(far, -least if self.metric == "euclidean" else math.sqrt(max(0, 2 - 2 * least)))
        return self._scan([c for c, b in zip(self.clusters, bound, strict=True) if b <= far + _ROOM * (1 + far)] if far < math.inf else self.clusters, query, k, where, least)

    def _scan(self, clusters: list[int], query: list[float], k: int, where: Column | None, least: float | None) -> DataFrame:
        rows = self.vectors().where(F.col("cluster").isin(clusters)).drop("cluster", "__away")
        return knn(rows, query, k, "id", "embedding", self.metric, where=where, least=least)


def build(vectors: DataFrame, path: str, dims: int, id_col: str = "id", vector_col: str = "embedding", metric: str = "cosine", clusters: int | None = None) -> VectorIndex:
    """Writes the index of all vectors of that size without null components; a hash of the ids chooses the centers, about as many as the root of the rows. Other columns are kept, but for one named cluster."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"no triangle inequality for {metric}")
    spark, others = vectors.sparkSession, [c for c in vectors.columns if c not in (id_col, vector_col, "cluster")]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), *others)
    rows = rows.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull()))
    n = rows.count()
    most = max(1, min(CLUSTERS, CENTER_BYTES // (8 * dims), clusters or math.isqrt(n)))
    rank = F.xxhash64("id")
    picked = rows.where(F.exists("embedding", lambda x: x != 0)).where(F.pmod(rank, F.lit(2**31)) < F.lit(int(min(1.0, 4 * most / max(1, n)) * 2**31) + 1))
    sample = [r["embedding"] for r in picked.orderBy(rank, "id").limit(most).select("embedding").collect()]
    centers = _points(np.array(sample or [[0.0] * dims]), metric)
    half = (centers * centers).sum(1) / 2

    def assign(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, dims)
            u = _points(x, metric)
            own = (u @ centers.T - half).argmax(1)
            away = np.sqrt(((u - centers[own]) ** 2).sum(1))
            if metric == "cosine":
                zero = ~x.any(1)
                own[zero], away[zero] = _ZERO, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(away)], [*batch.schema.names, "cluster", "__away"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cluster int, __away double"
    placed = rows.mapInArrow(assign, schema)
    placed.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(FILES))).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    schema = schema.replace(", cluster int, __away double", ", __away double, cluster int")  # partition columns stand last
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    found = stored.groupBy("cluster").agg(F.max("__away").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cluster").collect() if n else []  # a row a cluster
    names = [r["cluster"] for r in found]
    at = np.array([centers[max(c, 0)] for c in names]).reshape(-1, dims)
    return VectorIndex(spark, path, metric, names, at, np.array([r["radius"] for r in found]), np.array([r["n"] for r in found], int), schema)
