"""Approximate search over navigable graphs, one per partition.

Each partition's vectors make a graph of the M nearest neighbours, pruned so that links point in
different directions, with links both ways; a query walks it from an entry point with a list of ef
candidates. Partitions' results meet in one top-k. Partitions of SMALL or fewer rows are searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 1000


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == "ip":
        return -(x @ q)
    if metric == "cosine":
        return 1 - (x @ q) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(q), 1e-30)
    return ((x - q) ** 2).sum(1)


class Graph:
    def __init__(self, x: np.ndarray, metric: str = "l2", m: int = 16, block: int = 512):
        self.x, self.metric = x, metric
        n = len(x)
        links: list[set[int]] = [set() for _ in range(n)]
        for a in range(0, n, block):
            d = np.stack([_distances(metric, x, q) for q in x[a : a + block]])
            near = np.argsort(d, 1, kind="stable")[:, : 3 * m + 1]
            for i, row in enumerate(near, a):
                kept: list[int] = []
                for j in row.tolist():
                    if j != i and len(kept) < m and all(_distances(metric, x[k : k + 1], x[j])[0] > d[i - a, j] for k in kept):
                        kept.append(j)
                for j in kept:
                    links[i].add(j)
                    links[j].add(i)
        for i in range(1, n):  # a chain keeps the graph in one piece
            links[i].add(i - 1)
            links[i - 1].add(i)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entry = int(np.argmin(_distances("l2", x, x.mean(0)))) if n else 0

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        d = float(_distances(self.metric, self.x[self.entry][None], q)[0])
        seen, todo, best = {self.entry}, [(d, self.entry)], [(-d, self.entry)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i].tolist() if j not in seen]
            seen.update(new)
            if new:
                for dj, j in zip(_distances(self.metric, self.x[new], q).tolist(), new, strict=True):
                    if len(best) < ef or dj < -best[0][0]:
                        heapq.heappush(todo, (dj, j))
                        heapq.heappush(best, (-dj, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, i) for d, i in best)[:k]


def search(df: DataFrame, query: Sequence[float], topk: int = 10, metric: str = "l2", *, m: int = 16, ef: int = 300, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, score of about the topk nearest; score as the flat search gives it."""
    q = np.asarray(query, float)
    kind, sign = dict(df.dtypes)[id_col], -1.0 if metric == "ip" else 1.0

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            if not len(rows):
                continue
            x, ids = np.stack(rows[vector].to_numpy()).astype(float), rows[id_col].to_numpy()
            if len(x) <= SMALL:
                d = _distances(metric, x, q)
                found = [(d[i], i) for i in np.lexsort((ids, d))[:topk]]
            else:
                found = Graph(x, metric, m).search(q, topk, max(topk, ef))
            yield pd.DataFrame({id_col: [ids[i] for _, i in found], "score": [sign * d for d, _ in found]})

    near = df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInPandas(walk, f"`{id_col}` {kind}, score double")
    return near.orderBy(F.desc("score") if metric == "ip" else F.asc("score"), id_col).limit(topk)
