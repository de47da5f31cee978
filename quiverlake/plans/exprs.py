"""Arithmetic for added columns: + - * /, signs and parentheses over numbers and numeric columns.

Between integers / truncates toward zero and dividing by zero raises; otherwise it is floating.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>[-+*/()]))")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)


class ExpressionError(ValueError):
    pass


def compile_expression(text: str, schema: T.StructType) -> Column:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at} in {text!r}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else (None, None)

    def factor() -> tuple[Column, bool]:
        nonlocal place
        kind, v = peek()
        place += 1
        if kind == "num":
            whole = re.fullmatch(r"\d+", v) is not None
            return F.lit(int(v) if whole else float(v)).cast("long" if whole else "double"), whole
        if kind == "name":
            if peek()[1] == "(":
                raise ExpressionError(f"function {v} is not supported")
            if v not in schema.names or not isinstance(schema[v].dataType, NUMERIC):
                raise ExpressionError(f"{v} is no numeric column")
            whole = isinstance(schema[v].dataType, _INTEGERS)
            return F.col(v).cast("long" if whole else "double"), whole
        if v in ("+", "-"):
            c, whole = factor()
            return (-c if v == "-" else c), whole
        if v == "(":
            inner = total()
            if peek()[1] != ")":
                raise ExpressionError("a parenthesis isn't closed")
            place += 1
            return inner
        raise ExpressionError("the expression ends too early" if v is None else f"unexpected {v!r}")

    def product() -> tuple[Column, bool]:
        nonlocal place
        left, whole = factor()
        while peek()[1] in ("*", "/"):
            op = peek()[1]
            place += 1
            right, also = factor()
            both = whole and also
            if op == "*":
                left = left * right
            elif both:
                left = F.when(right == 0, F.raise_error(F.lit("divide by zero")).cast("long")).otherwise(_div(left, right))
            else:
                left = _float_divide(left, right)
            whole = both
        return left, whole

    def total() -> tuple[Column, bool]:
        nonlocal place
        left, whole = product()
        while peek()[1] in ("+", "-"):
            op = peek()[1]
            place += 1
            right, also = product()
            left, whole = (left + right if op == "+" else left - right), whole and also
        return left, whole

    out, _ = total()
    if place != len(tokens):
        raise ExpressionError(f"unexpected {tokens[place][1]!r}")
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _float_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull() | F.isnan(a) | (a == 0), F.when(a.isNotNull(), F.lit(float("nan")))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))
