"""Approximate nearest neighbours over randomly rotated one-bit codes.

An index row keeps, of a vector's residual to its cell's centroid: the signs after a random rotation, packed into 64-bit
words; its length; and the inner product of the unit residual with its code. A query is rotated too and
cut into PLANES bit planes of small numbers, so that its inner product with a code is a weighted sum of bit counts of
(plane AND code). Times the correction of the vector that estimates the inner product with the residual, with an error
of known spread. Vectors whose upper bound reaches the query's floor are scored exactly, in double precision.

A query's floor is a lower bound of its k-th best score: first one that 2 k vectors of the sample reach (at most SAMPLE
vectors, which also fit the centroids), then, as its task goes on, that of what was scored. Queries that are left with fewer than
k vectors, as when many equal ones fall under the bound, search once more without a floor. Index rows are dealt at random to runs of
at most RUN vectors, RUNS at least, and queries to blocks of at most RUN; a task holds one of each, so its memory is bounded. In it
the vectors are ordered by cell, and pieces whose cells can't reach a query's floor are skipped. A task sends back k rows
for each of its queries at most. Every vector is indexed, every query meets every run.

Null vectors, zero vectors and those with null or non-finite components take no part, nor do null ids. A query
meets vectors of its own dimension; a row with the query's id is no candidate. Ties go to the smaller id. A repeated
id is one vector for each row; as a query it has one list for each row. An empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.llm.common import cut, long_ids, need, table

TOP = 20
EVERY = 20
SAMPLE = 20_000
#: Cells: one for each PER_CELL vectors, at most MAX_CELLS.
PER_CELL, MAX_CELLS = 1600, 1024
RUN, RUNS = 500_000, 12
#: Bits of a rotated query's components.
PLANES = 4
#: Standard deviations of the error bound.
SIGMAS = 2.0
#: Queries and vectors of one tile of estimates, pairs that are scored at once.
ROWS, TILE, PAIRS = 64, 2048, 16_384
SEED = 11


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a column of lists, in the lists' own kind of number."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The vectors that take part, as (vec_id, v)."""
    need(vectors, id_col, vec_col)
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast(kind).alias("v"))


def centroids(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Lloyd's k-means from the first k rows."""
    found = sample[:k].copy()
    for _ in range(rounds):
        near = assign(sample, found)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        found[count > 0] = total[count > 0] / count[count > 0, None]
    return found


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096))])


def _packed(bits: np.ndarray) -> np.ndarray:
    """0-1 rows as 64-bit words."""
    held = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    got = np.packbits(bits, axis=1, bitorder="little")
    held[:, : got.shape[1]] = got
    return held.view("<u8")


class Coder:
    def __init__(self, sample: np.ndarray, ids: np.ndarray, cells: int):
        self.sample, self.ids, self.dim = sample, ids, sample.shape[1]
        self.found = centroids(sample, cells)
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((self.dim, self.dim)))
        self.turn = (q * np.sign(np.diag(r))).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, words of the code, length of the residual, inner product of its unit with the code."""
        x = x.astype(np.float32)
        cell = assign(x, self.found)
        rest = x - self.found[cell]
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ self.turn / np.maximum(length, 1e-30)[:, None]
        dot = np.abs(turned).sum(1) / np.sqrt(self.dim)
        return cell, _packed(turned > 0), length.astype(np.float32), dot.astype(np.float32)

    def floors(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that 2 k vectors of the sample reach, less what float32 may be off."""
        k *= 2
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf, np.float32)
        out = []
        for i in range(0, len(q), 256):
            score = q[i : i + 256].astype(np.float32) @ self.sample.T
            score[own[i : i + 256, None] == self.ids[None]] = -np.inf
            out.append(np.partition(score, len(self.ids) - k, axis=1)[:, len(self.ids) - k])
        most = np.linalg.norm(self.sample, axis=1).max()
        return np.concatenate(out) - 1e-5 * most * np.linalg.norm(q, axis=1).astype(np.float32)


class Run:
    """Index rows of one task, ordered by cell."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, code: np.ndarray, length: np.ndarray, dot: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.coder, self.ids, self.x, self.cell, self.code = coder, ids[order], x[order], cell[order], np.ascontiguousarray(code[order].T)
        dot, length, root = np.maximum(dot[order], 1e-6), length[order], np.sqrt(np.float32(coder.dim))
        self.scale = length / (dot * root)
        self.ones = np.bitwise_count(self.code).sum(0).astype(np.float32) * 2 - coder.dim
        #: Spread of the estimate for a query of length 1.
        self.spread = length * np.sqrt(np.maximum(1 - dot * dot, 0) / (dot * dot * max(coder.dim - 1, 1)))
        self.norm = np.linalg.norm(self.x.astype(np.float32), axis=1)

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, id and exact score of the k best of each query, as far as they reach its floor."""
        got = [self._block(q[i : i + ROWS], own[i : i + ROWS], floor[i : i + ROWS].copy(), k, i) for i in range(0, len(q), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _block(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, base: int):
        c = self.coder
        small = q.astype(np.float32)
        turned, size = small @ c.turn, np.linalg.norm(small, axis=1)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-12)
        number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = [_packed(number >> p & 1) for p in range(PLANES)]
        centre, total = small @ c.found.T, step * number.sum(1) + low * c.dim
        a_all, b_all, s_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        held = 0
        for lo in range(0, len(self.ids), TILE):
            at = slice(lo, lo + TILE)
            cells = self.cell[at]
            # how far each query may get in the cells of this piece; a little more for rounding
            inner, reach = np.unique(cells), (self.scale[at] * c.dim**0.5 + 1e-6).max()
            some = np.flatnonzero(centre[:, inner].max(1) + size * reach >= floor)
            if not len(some):
                continue
            count = np.zeros((len(some), len(cells)), np.uint32)
            for p, plane in enumerate(planes):
                for w, code in enumerate(self.code):
                    count += np.bitwise_count(plane[some, w, None] & code[None, at]).astype(np.uint32) << np.uint32(p)
            # code's signs times query: 2 (step * count + low * ones) - total, with ones held as 2 ones - dim
            near = count.astype(np.float32)
            near *= (2 * step[some])[:, None]
            near += low[some, None] * self.ones[None, at]
            near -= (total - low * c.dim)[some, None]
            near *= self.scale[None, at]
            near += centre[some][:, cells]
            off = np.sqrt(self.spread[None, at] ** 2 * (size[some] ** 2)[:, None] + self.scale[None, at] ** 2 * (c.dim / 12 * step[some] ** 2)[:, None])
            off *= SIGMAS
            near += off
            a, b = np.nonzero(near >= floor[some, None])
            a, b = some[a], b + lo
            other = own[a] != self.ids[b]
            a, b = a[other], b[other]
            for i in range(0, len(a), PAIRS):
                x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                rough = np.einsum("ij,ij->i", small[x], self.x[y].astype(np.float32))
                fine = rough >= floor[x] - 1e-5 * size[x] * self.norm[y]
                x, y = x[fine], y[fine]
                a_all.append(x)
                b_all.append(y)
                s_all.append((q[x].astype(np.float64) * self.x[y].astype(np.float64)).sum(1))
                held += len(x)
            if held > 8 * k * len(q):
                a, b, s = self._best(a_all, b_all, s_all, k)
                a_all, b_all, s_all, held = [a], [b], [s], len(a)
                many = np.bincount(a, minlength=len(q)) >= k
                last = np.full(len(q), np.inf)
                np.minimum.at(last, a, s)
                floor[many] = np.maximum(floor[many], (last[many] - 1e-9 * np.abs(last[many])).astype(np.float32) - 1e-6 * np.abs(last[many]).astype(np.float32))
        a, b, s = self._best(a_all, b_all, s_all, k)
        return a + base, self.ids[b], s

    def _best(self, a_all: list, b_all: list, s_all: list, k: int):
        a, b, s = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(s_all)
        order = np.lexsort((self.ids[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
        return a[keep], b[keep], s[keep]


def _alone(good: DataFrame, asked: DataFrame, dim: int, n: int, questions: int, k: int, floor: bool = True) -> DataFrame:
    """query_row, query_id, vec_id, score of vectors of one dimension; without floor all vectors are scored until k are."""
    spark = good.sparkSession
    share = max(1, -(-n // SAMPLE))  # each part of the input is asked for SAMPLE rows at most, in all about as many
    seen = good.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(share)) == 0).limit(SAMPLE).toArrow()
    sample, ids = matrix(seen.column("v"), dim).astype(np.float32), long_ids(seen.column("vec_id"))
    if not len(ids):
        sample, ids = np.zeros((1, dim), np.float32), np.zeros(1, np.int64)
    order = np.lexsort((*sample.T[::-1], ids))
    held = spark.sparkContext.broadcast(Coder(sample[order], ids[order], int(min(MAX_CELLS, len(ids), max(1, n // PER_CELL)))))
    runs, blocks = max(RUNS, -(-n // RUN)), max(1, -(-questions // RUN))
    kind = dict(good.dtypes)["v"]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code, length, dot = held.value.encode(matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": b.column("v"), "cell": pa.array(cell.astype(np.int32)), "code": pa.array([c.tobytes() for c in code], pa.binary()), "length": pa.array(length), "dot": pa.array(dot)})

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"query_row": b.column("query_row"), "query_id": b.column("vec_id"), "v": b.column("v"), "least": pa.array(held.value.floors(matrix(b.column("v"), dim), long_ids(b.column("vec_id")), k) if floor else np.full(b.num_rows, -np.inf, np.float32))})

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, np.ndarray] = {"query_row": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if left.num_rows and right.num_rows:
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), "<u8").reshape(left.num_rows, -1)
            run = Run(held.value, long_ids(left.column("vec_id")), matrix(left.column("v"), dim), left.column("cell").to_numpy(), code, left.column("length").to_numpy(), left.column("dot").to_numpy())
            own = long_ids(right.column("query_id"))
            a, b, s = run.search(matrix(right.column("v"), dim), own, right.column("least").to_numpy(), k)
            out = {"query_row": long_ids(right.column("query_row"))[a], "query_id": own[a], "vec_id": b, "score": s}
        return pa.table(out)

    index = good.mapInArrow(indexed, f"vec_id long, v {kind}, cell int, code binary, length float, dot float")
    index = index.withColumn("run", F.pmod(F.xxhash64("vec_id", "v"), F.lit(runs)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asked.mapInArrow(floored, f"query_row long, query_id long, v {kind}, least float")
    asking = asking.withColumn("block", F.pmod("query_row", F.lit(blocks)).cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return index.groupBy("run", "block").cogroup(asking.groupBy("run", "block")).applyInArrow(task, "query_row long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of which is_query holds, the k nearest found."""
    good = usable(vectors)
    # numbered once and kept: each row that asks has a list of its own
    asked = cut(usable(vectors.where(is_query)).withColumn("query_row", F.monotonically_increasing_id()))
    questions = {r["d"]: r["count"] for r in asked.groupBy(F.size("v").alias("d")).count().collect()}
    sizes = {r["d"]: r["count"] for r in good.groupBy(F.size("v").alias("d")).count().collect()}  # dimensions are few
    if not questions:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def of(rows: DataFrame, count: dict[int, int], floor: bool) -> DataFrame:
        return reduce(DataFrame.unionByName, [_alone(good.where(F.size("v") == d), rows.where(F.size("v") == d), d, sizes[d], n, k, floor) for d, n in sorted(count.items())])

    found = cut(of(asked, questions, True))
    enough = found.groupBy("query_row").count().where(F.col("count") >= k)
    short = cut(asked.where(reduce(lambda a, d: a | ((F.size("v") == d) & F.lit(sizes[d] > 2 * k)), sizes, F.lit(False))).join(enough, "query_row", "left_anti"))
    if left := {r["d"]: r["count"] for r in short.groupBy(F.size("v").alias("d")).count().collect()}:
        found = found.join(short.select("query_row"), "query_row", "left_anti").unionByName(of(short, left, False))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(EVERY)) == 0)
