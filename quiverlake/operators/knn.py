"""Exact nearest neighbours: one query, many queries, by id, within a radius, by group, refined.

A filter always comes before the top-k. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quiverlake.functions import distance, quantize
from quiverlake.plans.filters import scalar

MAX_TOPK = 1024
#: Queries that a batch search broadcasts at a time, and the most results that a task holds for them.
QUERY_BLOCK, HELD = 4096, 1 << 18
#: Queries and rows whose scores a task has at a time, and pairs that it scores again to the last digit.
TILE, PAIRS = (512, 2048), 1 << 14


def direction(metric: str, column: str = "score") -> Column:
    return F.desc(column) if distance.DESCENDING[metric] else F.asc(column)


def _checked(topk: int) -> int:
    if not 0 < topk <= MAX_TOPK:
        raise ValueError(f"topk is 1 to {MAX_TOPK}, not {topk}")
    return topk


def scored(df: DataFrame, query: Sequence[float] | Column, metric: str, vector: str = "embedding", where: str | None = None, digits: int | None = None) -> DataFrame:
    """Rows that pass the filter, with score; digits rounds it."""
    q = query if isinstance(query, Column) else distance.literal(query)
    s = distance.score(metric, F.col(vector), q)
    found = df.where(scalar(where, df.schema) & F.col(vector).isNotNull())
    return found.withColumn("score", F.round(s, digits) if digits is not None else s)


def knn(df: DataFrame, query: Sequence[float] | Column, topk: int = 10, metric: str = "l2", *, id_col: str = "vec_id", vector: str = "embedding", where: str | None = None, radius: float | None = None, digits: int | None = None) -> DataFrame:
    """The topk nearest rows (a TakeOrderedAndProject); radius keeps scores at least as good."""
    found = scored(df, query, metric, vector, where, digits)
    if radius is not None:
        found = found.where(F.col("score") >= radius if distance.DESCENDING[metric] else F.col("score") <= radius)
    return found.orderBy(direction(metric), id_col).limit(_checked(topk))


def knn_by_id(df: DataFrame, item, topk: int = 10, metric: str = "l2", *, id_col: str = "vec_id", vector: str = "embedding", **more) -> DataFrame:
    """With the vector of a stored row as the query; it finds itself too. The row is one, so it is broadcast."""
    query = df.where(F.col(id_col) == item).select(F.col(vector).alias("__q")).limit(1)
    joined = df.crossJoin(F.broadcast(query))
    return knn(joined, F.col("__q"), topk, metric, id_col=id_col, vector=vector, **more).drop("__q")


def knn_by_keys(df: DataFrame, keys: Sequence, query, topk: int = 10, metric: str = "l2", *, id_col: str = "vec_id", **more) -> DataFrame:
    """Exact search among given ids."""
    return knn(df.where(F.col(id_col).isin(list(keys))), query, topk, metric, id_col=id_col, **more)


def knn_group_by(df: DataFrame, query, group: str, per_group: int = 2, groups: int = 3, metric: str = "l2", *, id_col: str = "vec_id", vector: str = "embedding", where: str | None = None, digits: int | None = None) -> DataFrame:
    """The per_group nearest of each group, of the groups that have the nearest rows. A null group is ''."""
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    found = scored(df, query, metric, vector, where, digits).withColumn("group_key", key)
    best = found.withColumn("group_rank", F.row_number().over(Window.partitionBy("group_key").orderBy(direction(metric), id_col))).where(F.col("group_rank") <= per_group)
    # one row for each group at most
    top = best.where("group_rank = 1").orderBy(direction(metric), "group_key").limit(groups).select("group_key")
    return best.join(F.broadcast(top), "group_key")


def _vectors(held: pa.Array, dim: int) -> np.ndarray:
    if (pc.list_value_length(held).to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"the queries have {dim} components, a vector has another number")
    return held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), dim)


def _pair_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of q with the same row of x, the smaller the better."""
    if metric == "l2":
        return np.square(x - q).sum(1)
    products = (q * x).sum(1)
    if metric == "ip":
        return -products
    size = np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)
    return 1 - np.divide(products, size, out=np.where(np.isnan(size), np.nan, 0.0), where=size > 0)


class _Best:
    """The topk of some queries among the rows seen so far."""

    def __init__(self, q: np.ndarray, topk: int, metric: str, kind: pa.DataType):
        self.exact, self.topk, self.metric = q, topk, metric
        self.q = _unit(q) if metric == "cosine" else q
        self.norms = np.linalg.norm(self.q, axis=1)
        self.of, self.score, self.ids = np.zeros(0, int), np.zeros(0), pa.array([], kind)
        #: the score of the last of the topk, once there are so many
        self.last = np.full(len(q), np.inf)

    def see(self, exact: np.ndarray, x: np.ndarray, norms: np.ndarray, ids: pa.Array) -> None:
        s = self.q @ x.T
        if self.metric == "l2":
            s *= -2
            s += np.square(self.norms)[:, None]
            s += np.square(norms)[None]
        else:
            np.subtract(1.0 if self.metric == "cosine" else 0.0, s, out=s)
        # what rounding to 9 digits and the products' own error may move
        slack = 2e-9 + 1e-15 * (x.shape[1] + 8) * np.square(self.norms + norms.max())
        last = self.last
        if len(x) > self.topk and not np.isfinite(last).all():
            last = np.fmin(last, np.partition(s, self.topk - 1, axis=1)[:, self.topk - 1])
        near = ~(s > (last + slack)[:, None])  # what is not a number is scored below
        ends = np.cumsum(near.sum(1))
        at = 0
        while at < len(near):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            if ends[to - 1] > before:
                i, j = np.nonzero(near[at:to])
                self._add(i + at, _pair_scores(self.exact[i + at], exact[j], self.metric), ids.take(pa.array(j)))
            at = to

    def _add(self, of: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        of, score, ids = np.append(self.of, of), np.append(self.score, score), pa.concat_arrays([self.ids, ids])
        rounded = np.where(np.abs(score) < 1e7, np.round(score, 9), score)
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, rounded, of))
        starts = np.searchsorted(of[order], np.arange(len(self.last)))
        nth = np.arange(len(order)) - starts[of[order]]
        full = order[nth == self.topk - 1]
        self.last[of[full]] = rounded[full]
        keep = order[nth < self.topk]
        self.of, self.score, self.ids = of[keep], score[keep], ids.take(pa.array(keep))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.where(np.isnan(n), np.nan, np.zeros_like(x)), where=n > 0)


def _nearest(batches: Iterator[pa.RecordBatch], q: np.ndarray, topk: int, metric: str, kind: pa.DataType) -> list[_Best]:
    """The topk of all queries among a task's rows, some queries in each."""
    some_q = max(1, min(TILE[0], 2 * PAIRS // topk))
    best = [_Best(q[i : i + some_q], topk, metric, kind) for i in range(0, len(q), some_q)]
    for b in batches:
        for at in range(0, b.num_rows, TILE[1]):
            rows = b.slice(at, TILE[1])
            exact = _vectors(rows.column(1), q.shape[1])
            x = _unit(exact) if metric == "cosine" else exact
            norms = np.linalg.norm(x, axis=1)
            for some in best:
                some.see(exact, x, norms, rows.column(0))
    return best


def knn_batch(df: DataFrame, queries: DataFrame, topk: int = 10, metric: str = "l2", *, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query", dim: int | None = None) -> DataFrame:
    """The topk nearest for each query: query_id, id, score, rank.

    Queries are broadcast in blocks of QUERY_BLOCK vectors; each task keeps its own topk of every
    query by matrix products of tiles and only those are shuffled, once. Dense metrics l2, ip and cosine.
    """
    _checked(topk)
    if metric not in ("l2", "ip", "cosine"):
        raise ValueError("a batch search takes l2, ip or cosine")
    spark, sign = df.sparkSession, -1.0 if metric == "ip" else 1.0
    out = None
    kind, qkind = dict(df.dtypes)[id_col], dict(queries.dtypes)[query_id]
    own_type, asked_type = to_arrow_type(df.schema[id_col].dataType), to_arrow_type(queries.schema[query_id].dataType)
    asked = queries.select(query_id, query_vector).toLocalIterator()
    while rows := list(islice(asked, max(1, min(QUERY_BLOCK, HELD // topk)))):
        held = spark.sparkContext.broadcast((pa.array([r[0] for r in rows], asked_type), np.array([r[1] for r in rows], float)))

        def local(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            at = 0
            for some in _nearest(batches, q, topk, metric, own_type):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some.of + at)), some.ids, pa.array(sign * some.score)], names=[query_id, id_col, "score"])
                at += len(some.last)

        got = df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(local, f"`{query_id}` {qkind}, `{id_col}` {kind}, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], f"`{query_id}` {qkind}, `{id_col}` {kind}, score double, rank int")
    out = out.withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(direction(metric), id_col))
    return out.withColumn("rank", rank).where(F.col("rank") <= topk)


def knn_refined(df: DataFrame, query: Sequence[float], topk: int = 10, metric: str = "l2", *, factor: float = 4.0, kind: str = "int8", id_col: str = "vec_id", vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """A first top-k on quantised vectors, factor times as many, scored again on the originals."""
    coarse = df.withColumn("__approx", quantize.dequantize(quantize.quantize(vector, kind)))
    first = knn(coarse, query, min(MAX_TOPK, int(topk * factor)), metric, id_col=id_col, vector="__approx").drop("score", "__approx")
    return knn(first, query, topk, metric, id_col=id_col, vector=vector, digits=digits)


def sparse_knn(postings: DataFrame, query: dict, topk: int = 10, *, id_col: str = "doc_id", index: str = "index", value: str = "value", digits: int | None = None) -> DataFrame:
    """Largest inner product of sparse vectors held as postings (id, index, value); rows without a shared index are left out."""
    weights = F.create_map(*[x for k, v in query.items() for x in (F.lit(k), F.lit(float(v)))])
    s = F.sum(F.col(value).cast("double") * F.element_at(weights, F.col(index)))
    found = postings.where(F.col(index).isin(list(query))).groupBy(id_col).agg((F.round(s, digits) if digits is not None else s).alias("score"))
    return found.orderBy(F.desc("score"), id_col).limit(_checked(topk))
