"""Scalar quantisers as Column expressions, and fp16 rounding as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: levels spanned, lowest code
CODES = {"int8": (254.0, -127.0), "int4": (15.0, -8.0)}


def quantize(v: Column | str, kind: str = "int8") -> Column:
    """struct(codes, scale, bias): code = round(x * scale + bias) of each component, by the record's own range."""
    v = F.col(v) if isinstance(v, str) else v
    span, lowest = CODES[kind]
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when(high > low, F.lit(span) / (high - low)).otherwise(F.lit(1.0))
    bias = -low * scale + lowest
    codes = F.transform(v, lambda x: F.round(x.cast("double") * scale + bias).cast("int"))
    return F.struct(codes.alias("codes"), scale.alias("scale"), bias.alias("bias"))


def dequantize(q: Column | str) -> Column:
    q = F.col(q) if isinstance(q, str) else q
    return F.transform(q["codes"], lambda c: (c.cast("double") - q["bias"]) / q["scale"])


def pack_int4(q: Column) -> Column:
    """Two codes in each byte, the first in the low half."""
    u = F.transform(q["codes"], lambda c: c.bitwiseAND(F.lit(15)))
    at = F.sequence(F.lit(0), F.floor((F.size(u) - 1) / 2).cast("int"))
    return F.transform(at, lambda i: F.element_at(u, i * 2 + 1) + F.coalesce(F.get(u, i * 2 + 1), F.lit(0)) * 16)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fp16(v: pd.Series) -> pd.Series:
    """Components rounded to half precision; Spark has no such type."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))
