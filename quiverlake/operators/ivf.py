"""Cluster-pruned search: vectors in cells by nearest centroid, queries probe a few cells.

train() is Lloyd's k-means from the vectors with the smallest ids; write_index() partitions by cell, so
that a probe reads only its cells' files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import distance
from quiverlake.operators import knn as flat

SMALL = 1000
SAMPLE = 50_000


def train(df: DataFrame, n_list: int = 64, n_iters: int = 10, *, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centroids, from at most `sample` vectors, first by a hash of the id."""
    rows = df.where(F.col(vector).isNotNull()).select(vector, id_col, F.xxhash64(id_col).alias("h")).orderBy("h", id_col).limit(sample).collect()
    x = np.array([r[0] for r in sorted(rows, key=lambda r: r[1])], float)
    c = x[: min(n_list, len(x))].copy()
    for _ in range(n_iters):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, 1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(0)
    return c


def assign(df: DataFrame, centroids: np.ndarray, *, vector: str = "embedding", column: str = "cell") -> DataFrame:
    """With the nearest centroid's number, the first of equals."""
    pairs = F.array(*[F.struct(distance.squared_l2(F.col(vector), distance.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return df.withColumn(column, F.array_min(pairs)["i"])


def write_index(df: DataFrame, centroids: np.ndarray, path: str, *, vector: str = "embedding") -> None:
    assign(df, centroids, vector=vector).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def probes(centroids: np.ndarray, query: Sequence[float], nprobe: int, metric: str = "l2") -> list[int]:
    q = np.asarray(query, float)
    far = -(centroids @ q) if metric in ("ip", "mipsl2") else ((centroids - q) ** 2).sum(1)
    return [int(i) for i in np.argsort(far, kind="stable")[:nprobe]]


def search(index: DataFrame, centroids: np.ndarray, query: Sequence[float], topk: int = 10, metric: str = "l2", *, nprobe: int = 10, linear: bool = False, **more) -> DataFrame:
    """k-NN in the nprobe nearest cells; a partitioned index prunes to their files. linear searches all."""
    found = index if linear or nprobe >= len(centroids) else index.where(F.col("cell").isin(probes(centroids, query, nprobe, metric)))
    return flat.knn(found, query, topk, metric, **more)


def strategy(rows: int, kept: int | None = None) -> str:
    """'exact' for small collections and for filters that keep a tenth or less, else 'ivf'."""
    return "exact" if rows <= SMALL or kept is not None and kept * 10 <= rows else "ivf"


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cell_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("cell").agg(F.count("*").alias("n"))


def cell(index: DataFrame, n: int) -> Column:
    return index["cell"] == n
