"""A collection: versioned Parquet under one path, with a manifest that names the live version.

Every change writes a new version's files and then its manifest, through Spark, so the path may be
in any store that Spark writes. A reader takes the highest complete manifest; an interrupted change leaves none.
"""

from __future__ import annotations

import json
import uuid
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.operators import dml, fts, fusion, ivf, knn
from quiverlake.plans.filters import compile_filter
from quiverlake.sources.schema import KEY_PATTERN, UNSIGNED, CollectionSchema, Field, Index, SchemaError

_METRIC = {"L2": "l2", "IP": "ip", "COSINE": "cosine", "MIPSL2": "mipsl2"}
#: Compaction is due when more of the rows are deleted, or there are more parts.
DELETED_RATIO, MAX_PARTS = 0.3, 10


class Collection:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.schema = CollectionSchema.from_json(state["schema"])

    # ---- opening

    @staticmethod
    def create(spark: SparkSession, path: str, schema: CollectionSchema) -> Collection:
        schema.validate()
        out = Collection(spark, path, {"version": 0, "schema": schema.to_json(), "parts": [], "ivf": {}, "fts": {}})
        if out._exists(f"{out.path}/manifest"):
            raise FileExistsError(path)
        out._publish(out.state)
        return out

    @staticmethod
    def open(spark: SparkSession, path: str) -> Collection:
        rows = spark.read.schema("version long, body string").parquet(f"{path.rstrip('/')}/manifest/*")
        return Collection(spark, path, json.loads(rows.orderBy(F.desc("version")).first()["body"]))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _publish(self, state: dict) -> None:
        self.spark.createDataFrame([(state["version"], json.dumps(state))], "version long, body string").coalesce(1).write.parquet(f"{self.path}/manifest/v{state['version']:08d}")
        self.state, self.schema = state, CollectionSchema.from_json(state["schema"])

    def _replace(self, df: DataFrame, schema: CollectionSchema | None = None) -> None:
        part = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        self._publish(self.state | {"version": self.state["version"] + 1, "parts": [part], "schema": (schema or self.schema).to_json()})

    # ---- reading

    def df(self) -> DataFrame:
        """All live rows."""
        if not self.state["parts"]:
            return self.spark.createDataFrame([], self.schema.struct())
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in self.state["parts"]])

    def stats(self) -> dict:
        """index_completeness: 1 for an index that covers the live rows, 0 for one not built, or built before the last change."""
        return {"doc_count": self.df().count(), "index_completeness": {f.name: float(self._covered(f)) for f in self.schema.fields if f.index}}

    def _covered(self, f: Field) -> bool:
        if f.index.kind in ("IVF", "FTS"):
            return self._built(f.index.kind, f.name) is not None
        return f.index.kind in ("FLAT", "INVERT")  # these search the rows themselves

    def _built(self, kind: str, name: str) -> dict | None:
        """A written index, if it is of the live rows."""
        index = self.state.get(kind.lower(), {}).get(name)
        return index if index and index.get("parts") == self.state["parts"] else None

    def _metric(self, name: str) -> str:
        f = self.schema.field(name)
        return _METRIC[f.index.metric if f.index else "IP"]

    def fetch(self, keys: list[str]) -> DataFrame:
        return dml.fetch(self.df(), keys, self.schema.key)

    def _fields(self, output_fields: list[str] | None, include_vector: bool) -> list[str]:
        names = [f.name for f in self.schema.fields if include_vector or not f.is_vector] if output_fields in (None, ["*"]) else list(output_fields)
        for n in names:
            self.schema.field(n)
        return [self.schema.key, *names]

    def query(self, vector: tuple[str, list[float]] | None = None, *, id: str | None = None, where: str | None = None, topk: int = 10, output_fields: list[str] | None = None, include_vector: bool = False, radius: float | None = None, nprobe: int | None = None, order: str | None = None) -> DataFrame:
        """k-NN by (field, vector) or by a stored row's vector, or a filtered scan without one.

        A vector relation in the filter is such a (field, vector). nprobe uses an IVF index of the live rows; without
        one the search is exact, with a warning.
        """
        names = self._fields(output_fields, include_vector)
        rows, compiled = self.df(), compile_filter(where, self.schema.struct())
        if compiled.vector:
            if vector is not None or id is not None:
                raise SchemaError("one vector, in the call or in the filter")
            if not self.schema.field(compiled.vector[0]).is_vector:
                raise SchemaError(f"{compiled.vector[0]} is no vector")
            vector = (compiled.vector[0], list(compiled.vector[1]))
        if vector is None:
            return dml.scan(rows, names, where, topk, order, key=self.schema.key)
        f = self.schema.field(vector[0])
        metric = self._metric(f.name)
        more = {"id_col": self.schema.key, "vector": f.name, "radius": radius}
        if f.kind.startswith("SPARSE"):
            raise SchemaError("sparse fields are searched by query_sparse")
        if id is not None:
            found = knn.knn_by_id(rows, id, topk, metric, where=where, **more)
        else:
            if len(vector[1]) != f.dimension:
                raise SchemaError(f"{f.name} has {f.dimension} dimensions")
            index = self._built("IVF", f.name) if nprobe else None
            if index:
                import numpy as np

                cells = ivf.open_index(self.spark, f"{self.path}/{index['path']}").where(compiled.predicate)
                found = ivf.search(cells, np.array(index["centroids"]), vector[1], topk, metric, nprobe=nprobe, **more)
            else:
                if nprobe:
                    warnings.warn(f"{f.name} has no index of the live rows; optimize() builds it", stacklevel=2)
                found = knn.knn(rows.where(compiled.predicate), vector[1], topk, metric, **more)
        return found.select(*names, "score")

    def query_sparse(self, name: str, query: dict[int, float], topk: int = 10) -> DataFrame:
        f = F.col(self.schema.field(name).name)
        rows = self.df().select(self.schema.key, F.explode(F.arrays_zip(f["indices"].alias("index"), f["vals"].alias("value"))).alias("x")).select(self.schema.key, "x.index", "x.value")
        return knn.sparse_knn(rows, query, topk, id_col=self.schema.key)

    def query_text(self, name: str, text: str, *, match: str = "or", topk: int = 10, output_fields: list[str] | None = None) -> DataFrame:
        f = self.schema.field(name)
        if f.kind != "STRING" or f.index is None or f.index.kind != "FTS":
            raise SchemaError(f"{name} has no full-text index")
        params = dict(f.index.params)
        more = {"id_col": self.schema.key, "k1": float(params.get("k1", fts.K1)), "b": float(params.get("b", fts.B))}
        if index := self._built("FTS", name):
            found = fts.search_index(self.spark, f"{self.path}/{index['path']}", text, topk, match, **more)
        else:
            found = fts.search(self.df(), text, topk, match, text=name, **more)
        if output_fields == []:
            return found
        return found.join(self.df().select(*self._fields(output_fields, output_fields is None)), self.schema.key).orderBy(F.desc("score"), self.schema.key)

    def query_hybrid(self, vectors: list[tuple[str, list[float]]], text: tuple[str, str] | None = None, *, topk: int = 10, where: str | None = None, weights: list[float] | None = None) -> DataFrame:
        """Several lists fused by reciprocal ranks, or by weights when all lists are vectors of one metric."""
        if len({v[0] for v in vectors}) < len(vectors):
            raise SchemaError("vector fields repeat")
        key = self.schema.key
        metrics = [self._metric(n) for n, _ in vectors]
        lists = [self.query((n, v), where=where, topk=topk, output_fields=[]).select(key, "score") for n, v in vectors]
        if weights is not None:
            if text or len(set(metrics)) > 1:
                raise SchemaError("weights need vectors of one metric")
            return fusion.weighted(list(zip(lists, weights, strict=True)), metrics[0], topk, id_col=key)
        ranked = [(df, knn.distance.DESCENDING[m]) for df, m in zip(lists, metrics, strict=True)]
        if text:
            ranked.append((self.query_text(text[0], text[1], topk=topk, output_fields=[]), True))
        return fusion.rrf(ranked, topk, id_col=key)

    # ---- writing

    def _checked(self, df: DataFrame, partial: bool = False) -> DataFrame:
        """Rows with the schema's types; any row that breaks it fails the whole call."""
        key, names = self.schema.key, {f.name for f in self.schema.fields}
        if unknown := set(df.columns) - names - {key, "__order"}:
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        bad = [(F.col(key).isNull() | ~F.col(key).rlike(KEY_PATTERN), f"bad {key}")]
        columns = [F.col(key).cast("string").alias(key)]
        for f in self.schema.fields:
            if f.name not in df.columns:
                if not partial:
                    if not f.nullable:
                        raise SchemaError(f"{f.name} is missing")
                    columns.append(F.lit(None).cast(f.spark_type()).alias(f.name))
                continue
            c = F.col(f.name)
            if not f.nullable:
                bad.append((c.isNull(), f"{f.name} is null"))
            if f.is_vector and not f.kind.startswith("SPARSE"):
                bad.append((F.size(c) != f.dimension, f"{f.name} has another dimension"))
            if f.kind in UNSIGNED:
                bad.append(((c < 0) | (c > F.lit(str(UNSIGNED[f.kind])).cast("decimal(20,0)")), f"{f.name} is out of range"))
            columns.append(c.cast(f.spark_type()).alias(f.name))
        problem = F.coalesce(*[F.when(cond, F.lit(why)) for cond, why in bad])
        first = df.select(problem.alias("p")).where("p is not null").first()
        if first:
            raise SchemaError(first[0])
        return df.select(*columns, F.col("__order") if "__order" in df.columns else F.monotonically_increasing_id().alias("__order"))

    def _staged(self, df: DataFrame, partial: bool = False) -> DataFrame:
        """Checked rows, written once, so that status and rows go by one order also when tasks run again."""
        return self._kept(self._checked(df, partial), "staged")

    def insert(self, df: DataFrame) -> DataFrame:
        """New keys are added; the status of each row is OK or ALREADY_EXISTS."""
        new = self._staged(df)
        rows, status = dml.insert(self.df(), new, self.schema.key, "__order")
        out = self._kept(status.select(self.schema.key, "status"))
        self._replace(rows)
        return out

    def _kept(self, status: DataFrame, folder: str = "status") -> DataFrame:
        """A status is judged on the version before the change, so it is written before."""
        path = f"{self.path}/{folder}/{uuid.uuid4().hex}"
        status.write.parquet(path)
        return self.spark.read.parquet(path)

    def upsert(self, df: DataFrame) -> None:
        self._replace(dml.upsert(self.df(), self._staged(df), self.schema.key, "__order"))

    def update(self, df: DataFrame) -> DataFrame:
        """Fields that df has replace those of the row, nulls too; the status is OK or NOT_FOUND."""
        new = self._staged(df, partial=True)
        new = dml.latest(new, self.schema.key, "__order").drop("__order")
        rows, status = dml.update(self.df(), new, self.schema.key)
        out = self._kept(status)
        self._replace(rows)
        return out

    def delete(self, keys: list[str]) -> DataFrame:
        gone = self.spark.createDataFrame([(k,) for k in keys], f"{self.schema.key} string")
        _, status = dml.update(self.df(), gone, self.schema.key)
        out = self._kept(status)
        self._replace(dml.delete(self.df(), gone, self.schema.key))
        return out

    def delete_by_filter(self, where: str) -> None:
        self._replace(dml.delete_by_filter(self.df(), where))

    # ---- columns and indexes

    def _with_fields(self, fields) -> CollectionSchema:
        return replace(self.schema, fields=tuple(fields)).validate()

    def add_column(self, new: Field, expression: str | None = None) -> None:
        if expression is None and not new.nullable:
            raise SchemaError("without an expression a new column is nullable")
        self._replace(dml.add_column(self.df(), new.name, new.spark_type(), expression), self._with_fields([*self.schema.fields, new]))

    def alter_column(self, name: str, rename: str | None = None, kind: str | None = None) -> None:
        old = self.schema.field(name)
        new = replace(old, name=rename or name, kind=kind or old.kind)
        self._replace(dml.alter_column(self.df(), name, rename, new.spark_type() if kind else None), self._with_fields([new if f.name == name else f for f in self.schema.fields]))

    def drop_column(self, name: str) -> None:
        self._replace(dml.drop_column(self.df(), name), self._with_fields([f for f in self.schema.fields if f.name != name]))

    def create_index(self, name: str, index: Index) -> None:
        """Sets the descriptor and, for IVF and FTS, writes the index. The same index again changes nothing."""
        old = self.schema.field(name)
        if old.index == index:
            return
        schema = self._with_fields([replace(f, index=index) if f.name == name else f for f in self.schema.fields])
        state = self._unindexed(name) | {"version": self.state["version"] + 1, "schema": schema.to_json()}
        self._publish(state | self._written(state, name, index))

    def _unindexed(self, name: str) -> dict:
        return self.state | {kind: {k: v for k, v in self.state.get(kind, {}).items() if k != name} for kind in ("ivf", "fts")}

    def _written(self, state: dict, name: str, index: Index) -> dict:
        """Writes an index of the live rows; what the state then says of it."""
        path = f"index/{uuid.uuid4().hex}"
        held = {"path": path, "parts": self.state["parts"]}
        if index.kind == "FTS":
            fts.write_index(self.df(), f"{self.path}/{path}", text=name, id_col=self.schema.key)
            return {"fts": state["fts"] | {name: held}}
        if index.kind != "IVF":
            return {}
        params = dict(index.params)
        centroids = ivf.train(self.df(), int(params.get("n_list", 64)), int(params.get("n_iters", 10)), id_col=self.schema.key, vector=name)
        ivf.write_index(self.df(), centroids, f"{self.path}/{path}", vector=name)
        return {"ivf": state["ivf"] | {name: held | {"centroids": centroids.tolist()}}}

    def drop_index(self, name: str) -> None:
        schema = self._with_fields([replace(f, index=None) if f.name == name else f for f in self.schema.fields])
        self._publish(self._unindexed(name) | {"version": self.state["version"] + 1, "schema": schema.to_json()})

    def optimize(self) -> None:
        """Rewrites the rows in key ranges of at most max_docs_per_segment and the indexes of them."""
        rows = self.df()
        files = max(1, -(-rows.count() // self.schema.max_docs_per_segment))
        self._replace(rows.repartitionByRange(files, self.schema.key))
        state = {"ivf": {}, "fts": {}} | self.state
        for f in self.schema.fields:
            if f.index:
                state = state | self._written(state, f.name, f.index)
        if state != self.state:
            self._publish(state | {"version": self.state["version"] + 1})

    def flush(self) -> None:
        """Changes are durable once they return."""

    def destroy(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)


def compaction_due(parts: int, rows: int, deleted: int) -> bool:
    return parts > MAX_PARTS or rows > 0 and deleted / rows > DELETED_RATIO


def shard_of(key, shards: int):
    """A row's write shard."""
    return F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(shards))


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, dml.NUMERIC)
