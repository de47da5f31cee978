"""Fusion of ranked lists: reciprocal ranks, weighted normalised scores, hybrid vector and text search, re-ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def ranked(df: DataFrame, id_col: str, descending: bool) -> DataFrame:
    """Rank from 0 of a list that a top-k has already bounded."""
    order = F.desc("score") if descending else F.asc("score")
    return df.select(id_col, "score", (F.row_number().over(Window.orderBy(order, id_col)) - 1).alias("rank0"))


def rrf(lists: list[tuple[DataFrame, bool]], topn: int = 10, *, id_col: str = "doc_id", k: int = RANK_CONSTANT, digits: int | None = None) -> DataFrame:
    """Sum over lists of 1 / (k + rank + 1); lists: (id, score) tables and whether larger is better. One list is returned as it is."""
    if len(lists) == 1:
        return lists[0][0].select(id_col, "score")
    parts = [ranked(df, id_col, down).select(id_col, (1 / (F.lit(float(k)) + F.col("rank0") + 1)).alias("part")) for df, down in lists]
    return _summed(parts, id_col, topn, digits)


def normalized(metric: str, score: Column) -> Column:
    """To about 0..1, larger is better."""
    if metric == "l2":
        return 1 - 2 * F.atan(score) / F.lit(3.141592653589793)
    if metric == "ip":
        return 0.5 + F.atan(score) / F.lit(3.141592653589793)
    if metric == "cosine":
        return 1 - score / 2
    raise ValueError(f"no normalisation for {metric}")


def weighted(lists: list[tuple[DataFrame, float]], metric: str, topn: int = 10, *, id_col: str = "doc_id", digits: int | None = None) -> DataFrame:
    """Sum of weight times normalised score; one metric for all lists."""
    if len(lists) == 1:
        return lists[0][0].select(id_col, "score")
    parts = [df.select(id_col, (F.lit(float(w)) * normalized(metric, F.col("score"))).alias("part")) for df, w in lists]
    return _summed(parts, id_col, topn, digits)


def _summed(parts: list[DataFrame], id_col: str, topn: int, digits: int | None) -> DataFrame:
    total = F.sum("part")
    both = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg((F.round(total, digits) if digits is not None else total).alias("score"))
    return both.orderBy(F.desc("score"), id_col).limit(topn)


def rerank(df: DataFrame, query: str, field: str, scorer: Callable[[list[tuple[str, str]]], list[float]], topn: int = 10, *, id_col: str = "doc_id") -> DataFrame:
    """A model's own order: distinct ids scored on (query, field text) pairs, Arrow batches at a time."""

    @F.pandas_udf("double")
    def model(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer([(query, t or "") for t in texts]), dtype=float)

    return df.dropDuplicates([id_col]).withColumn("score", model(F.col(field))).orderBy(F.desc("score"), id_col).limit(topn)
