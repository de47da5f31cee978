"""Changes of a table of documents as DataFrame plans: insert, upsert, update, delete, columns, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.plans.exprs import NUMERIC, compile_expression
from quiverlake.plans.filters import scalar


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The row with the highest version of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with rows of changes in place of theirs; the last by order wins within changes."""
    new = latest(changes, key, order).select(*base.columns)
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new)


def insert(base: DataFrame, new: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """base with new keys, and the status of each new row: OK or ALREADY_EXISTS; the first by order wins within new."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    known = base.select(F.col(key), F.lit(True).alias("__known"))
    marked = new.withColumn("__first", first).join(known, key, "left")
    marked = marked.withColumn("status", F.when(F.col("__first") & F.col("__known").isNull(), "OK").otherwise("ALREADY_EXISTS"))
    added = marked.where("status = 'OK'").select(*base.columns)
    return base.unionByName(added), marked.select(key, order, "status")


def update(base: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """base with the columns of changes in place of its own, nulls too; and each change's status: OK or NOT_FOUND."""
    fields = [c for c in changes.columns if c != key and c in base.columns]
    new = changes.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    merged = base.join(new, key, "left").select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])
    have = base.select(F.col(key), F.lit(True).alias("__have"))
    status = changes.join(have, key, "left").select(key, F.when(F.col("__have"), "OK").otherwise("NOT_FOUND").alias("status"))
    return merged, status


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti").select(*base.columns)


def delete_by_filter(base: DataFrame, where: str) -> DataFrame:
    """Rows for which the filter isn't true, nulls included, stay."""
    return base.where(~F.coalesce(scalar(where, base.schema), F.lit(False)))


def fetch(base: DataFrame, keys: list, key: str) -> DataFrame:
    return base.where(F.col(key).isin(keys))


def add_column(base: DataFrame, name: str, kind: T.DataType, expression: str | None = None) -> DataFrame:
    """A numeric column: null, or an arithmetic expression over numeric columns."""
    if name in base.columns or not isinstance(kind, NUMERIC):
        raise ValueError("a new column has a new name and a numeric type")
    value = F.lit(None) if expression is None else compile_expression(expression, base.schema)
    return base.withColumn(name, value.cast(kind))


def alter_column(base: DataFrame, name: str, rename: str | None = None, kind: T.DataType | None = None) -> DataFrame:
    """A new name or another numeric type, one of the two."""
    if (rename is None) == (kind is None):
        raise ValueError("either a new name or a new type")
    if not isinstance(base.schema[name].dataType, NUMERIC) or kind is not None and not isinstance(kind, NUMERIC):
        raise ValueError("only numeric columns change")
    return base.withColumnRenamed(name, rename) if rename else base.withColumn(name, F.col(name).cast(kind))


def drop_column(base: DataFrame, name: str) -> DataFrame:
    if not isinstance(base.schema[name].dataType, NUMERIC):
        raise ValueError("only numeric columns are dropped")
    return base.drop(name)


def compact(parts: DataFrame, deleted: DataFrame, key: str, rows_per_file: int, order: str) -> DataFrame:
    """Live rows in ranges of order, about rows_per_file to each file."""
    live = parts.join(deleted.select(key), key, "left_anti")
    files = max(1, -(-live.count() // rows_per_file))
    return live.repartitionByRange(files, order)


def scan(base: DataFrame, fields: list[str] | None = None, where: str | None = None, limit: int = 20, order: str | None = None, descending: bool = False, key: str = "pk") -> DataFrame:
    """Projection, filter and limit; the order is stated, else by key, so that a limit always means the same rows."""
    found = base.where(scalar(where, base.schema))
    first = [F.desc(order) if descending else F.asc(order)] if order else []
    found = found.orderBy(*first, key).limit(limit)
    return found if fields is None or fields == ["*"] else found.select(*fields)
