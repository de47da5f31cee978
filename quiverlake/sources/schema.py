"""Schemas of collections: field types, index descriptors, validation, and their Spark form."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# fixed values: limits of names and sizes
COLLECTION_NAME = re.compile(r"[a-zA-Z0-9_-]{3,64}$")
FIELD_NAME = re.compile(r"[a-zA-Z0-9_-]{1,32}$")
KEY_PATTERN = r"^[a-zA-Z0-9_!@#$%+=.-]{1,64}$"
MAX_DIMENSION, MAX_SCALARS, MAX_VECTORS, MAX_NONZERO, MAX_BATCH = 20_000, 1024, 5, 16_384, 1024
DEFAULT_SEGMENT, LEAST_SEGMENT = 10_000_000, 1000

_SCALARS = {"STRING": T.StringType(), "BINARY": T.BinaryType(), "BOOL": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType()}
_SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("vals", T.ArrayType(T.FloatType()))])
_VECTORS = {"VECTOR_FP32": T.ArrayType(T.FloatType()), "VECTOR_FP16": T.ArrayType(T.FloatType()), "VECTOR_INT8": T.ArrayType(T.ByteType()), "SPARSE_VECTOR_FP32": _SPARSE, "SPARSE_VECTOR_FP16": _SPARSE}
UNSIGNED = {"UINT32": 2**32 - 1, "UINT64": 2**64 - 1}
INDEXES = {"dense": {"FLAT", "HNSW", "HNSW_RABITQ", "IVF"}, "sparse": {"FLAT", "HNSW"}, "scalar": {"INVERT", "FTS"}}
METRICS = {"L2", "IP", "COSINE", "MIPSL2"}
QUANTIZERS = {"VECTOR_FP32": {"FP16", "INT8", "INT4", "RABITQ"}, "SPARSE_VECTOR_FP32": {"FP16"}}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Index:
    """kind FLAT, HNSW, HNSW_RABITQ, IVF, INVERT or FTS; params as each kind knows them."""

    kind: str
    metric: str = "IP"
    quantize: str | None = None
    params: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False
    dimension: int = 0
    index: Index | None = None

    @property
    def is_vector(self) -> bool:
        return "VECTOR" in self.kind

    def spark_type(self) -> T.DataType:
        if self.kind in _VECTORS:
            return _VECTORS[self.kind]
        if self.kind.startswith("ARRAY_") and self.kind[6:] in _SCALARS:
            return T.ArrayType(_SCALARS[self.kind[6:]])
        if self.kind in _SCALARS:
            return _SCALARS[self.kind]
        raise SchemaError(f"{self.name}: no type {self.kind}")

    def validate(self) -> None:
        if not FIELD_NAME.match(self.name):
            raise SchemaError(f"{self.name!r} is no field name")
        self.spark_type()
        sparse = self.kind.startswith("SPARSE")
        if self.is_vector and not sparse and not 0 < self.dimension <= MAX_DIMENSION:
            raise SchemaError(f"{self.name}: a dimension of 1 to {MAX_DIMENSION}")
        if self.index is None:
            return
        family = "sparse" if sparse else "dense" if self.is_vector else "scalar"
        i = self.index
        if i.kind not in INDEXES[family]:
            raise SchemaError(f"{self.name}: no {i.kind} index on {family} fields")
        if i.kind == "FTS" and self.kind != "STRING":
            raise SchemaError(f"{self.name}: full text is for strings")
        if family == "scalar":
            return
        if i.metric not in METRICS or sparse and i.metric != "IP":
            raise SchemaError(f"{self.name}: no metric {i.metric} here")
        if i.quantize and i.quantize not in QUANTIZERS.get(self.kind, set()):
            raise SchemaError(f"{self.name}: {i.quantize} doesn't quantise {self.kind}")
        if i.metric == "COSINE" and self.kind not in ("VECTOR_FP32", "VECTOR_FP16"):
            raise SchemaError(f"{self.name}: cosine is for fp32 and fp16")
        if "RABITQ" in (i.kind, i.quantize, i.kind[5:]) and not (self.kind == "VECTOR_FP32" and 64 <= self.dimension <= 4095 and i.metric in ("L2", "IP", "COSINE")):
            raise SchemaError(f"{self.name}: one-bit codes are for fp32 of 64 to 4095 dimensions")


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    fields: tuple[Field, ...]
    max_docs_per_segment: int = DEFAULT_SEGMENT
    key: str = field(default="pk")

    def validate(self) -> CollectionSchema:
        if not COLLECTION_NAME.match(self.name):
            raise SchemaError(f"{self.name!r} is no collection name")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names) or self.key in names:
            raise SchemaError("field names repeat")
        vectors = [f for f in self.fields if f.is_vector]
        if not 1 <= len(vectors) <= MAX_VECTORS or len(self.fields) - len(vectors) > MAX_SCALARS:
            raise SchemaError(f"1 to {MAX_VECTORS} vector fields and up to {MAX_SCALARS} others")
        if self.max_docs_per_segment < LEAST_SEGMENT:
            raise SchemaError(f"segments of {LEAST_SEGMENT} documents and more")
        for f in self.fields:
            f.validate()
        return self

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field {name}")

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(self.key, T.StringType(), False), *(T.StructField(f.name, f.spark_type(), True, {"kind": f.kind, "dimension": f.dimension}) for f in self.fields)])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> CollectionSchema:
        d = json.loads(text)
        fields = tuple(Field(**{**f, "index": Index(**{**f["index"], "params": tuple(map(tuple, f["index"]["params"]))}) if f["index"] else None}) for f in d["fields"])
        return CollectionSchema(d["name"], fields, d["max_docs_per_segment"], d["key"])
