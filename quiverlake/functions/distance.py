"""Distances between vectors as Column expressions, in double precision.

Vectors are arrays of numbers; sparse ones are structs (indices, vals) sorted by index. A metric's
score is what a user sees; DESCENDING says which metrics are better when larger.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DESCENDING = {"l2": False, "euclidean": False, "cosine": False, "normalized_cosine": False, "ip": True, "mipsl2": True, "hamming": False, "sparse_ip": True, "sparse_l2": False}


def literal(vector: Sequence[float]) -> Column:
    """A vector literal of doubles."""
    return F.lit([float(x) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def squared_l2(a, b) -> Column:
    """Sum of squared differences, not square-rooted."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a, b) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm1(a) -> Column:
    return _sum(F.transform(_double(a), lambda x: F.abs(x.cast("double"))))


def norm2(a) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x.cast("double") * x.cast("double"))))


def normalize(a) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm2(a)
    return F.transform(_double(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a, b) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    n = norm2(a) * norm2(b)
    return F.when(n > 0, 1 - inner_product(a, b) / n).otherwise(F.lit(1.0))


def normalized_cosine(a, b) -> Column:
    """1 - inner product, for vectors of length 1."""
    return 1 - inner_product(a, b)


def hamming(a, b) -> Column:
    """Differing bits of two arrays of integers."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.bit_count(x.cast("long").bitwiseXOR(y.cast("long")))), F.lit(0), lambda acc, x: acc + x)


def sign_bits(a) -> Column:
    """One bit for each component (1 if positive), 32 in each long."""
    v = _double(a)
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 32).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(v, w * 32 + 1, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)))


def _as_map(v: Column) -> Column:
    return F.map_from_arrays(v["indices"], F.transform(v["vals"], lambda x: x.cast("double")))


def sparse_ip(a, b) -> Column:
    """Sum of products over shared indexes."""
    left, right = _double(a), _as_map(_double(b))
    return _sum(F.zip_with(left["indices"], left["vals"], lambda i, x: x.cast("double") * F.coalesce(F.try_element_at(right, i), F.lit(0.0))))


def sparse_l2(a, b) -> Column:
    return _sum(F.map_values(F.map_zip_with(_as_map(_double(a)), _as_map(_double(b)), lambda _, x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 2))))


def mips_spherical(a, longest: Column, query: bool = False) -> Column:
    """Maximum inner product as squared distance: scaled to the unit ball, with one component that lifts it to the sphere."""
    v = F.transform(_double(a), lambda x: x.cast("double") / (norm2(a) if query else longest))
    extra = F.lit(0.0) if query else F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(norm2(a) / longest, 2)))
    return F.concat(v, F.array(extra))


def mips_quadratic(a, longest: Column, m: int = 3, u: float = 0.38196601, query: bool = False) -> Column:
    """Maximum inner product as squared distance: scaled by u, with m components 1/2 - |v|**(2**i)."""
    v = F.transform(_double(a), lambda x: x.cast("double") * (F.lit(1.0) if query else F.lit(u) / longest))
    size = norm2(a) * (F.lit(0.0) if query else F.lit(u) / longest)
    return F.concat(v, F.array(*[F.lit(0.0) if query else F.lit(0.5) - F.pow(size, 2 ** (i + 1)) for i in range(m)]))


METRICS = {"l2": squared_l2, "euclidean": euclidean, "ip": inner_product, "mipsl2": inner_product, "cosine": cosine, "normalized_cosine": normalized_cosine, "hamming": hamming, "sparse_ip": sparse_ip, "sparse_l2": sparse_l2}


def score(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; there are {sorted(METRICS)}")
    return METRICS[metric](a, b)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
