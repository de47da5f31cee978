"""The filter dialect: a predicate text becomes a Column, checked against a schema.

    expr := term (OR term)* ; term := factor (AND factor)* ; factor := ( expr ) | relation
    relation := field = != < <= > >= literal | field [NOT] IN (..) | field LIKE 'pattern'
              | field [NOT] CONTAIN_ALL / CONTAIN_ANY (..) | field IS [NOT] NULL
              | array_length(field) op integer | vector = [..]

Keywords are in either case. There is no NOT before an expression and no BETWEEN. Comparisons with
null drop the row, also under NOT. Literals take the column's type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_IN, MAX_CONTAIN, MAX_RELATIONS = 20_000, 32, 4096


class FilterError(ValueError):
    pass


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<op><=|>=|!=|=|<|>)|(?P<punct>[(),\[\]])|(?P<word>[-+]?[A-Za-z0-9_.][A-Za-z0-9_.+-]*))""")
_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
_NAME = re.compile(r"[A-Za-z0-9_-]+$")


@dataclass(frozen=True)
class Relation:
    field: str
    op: str
    value: object = None
    length: bool = False


@dataclass(frozen=True)
class Tree:
    op: str
    parts: tuple


@lru_cache(maxsize=100)
def parse(text: str) -> Tree | Relation:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected character at {at} in {text!r}")
        found.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    parser = _Parser(found)
    tree = parser.expr()
    if parser.at != len(found):
        raise FilterError(f"unexpected {found[parser.at][1]!r}")
    if parser.relations > MAX_RELATIONS:
        raise FilterError(f"more than {MAX_RELATIONS} relations")
    return tree


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at, self.relations = tokens, 0, 0

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise FilterError("the filter ends too early")
        k, v = self.tokens[self.at]
        if kind and k != kind or value and v.upper() != value:
            raise FilterError(f"expected {value or kind}, found {v!r}")
        self.at += 1
        return v

    def chain(self, word: str, part):
        parts = [part()]
        while self.peek() == word:
            self.at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else Tree(word, tuple(parts))

    def expr(self):
        return self.chain("OR", self.term)

    def term(self):
        return self.chain("AND", self.factor)

    def factor(self):
        if self.peek() == "(":
            self.at += 1
            inner = self.expr()
            self.take("punct", ")")
            return inner
        return self.relation()

    def relation(self) -> Relation:
        self.relations += 1
        name = self.take("word")
        if self.peek() == "(":
            if name.lower() != "array_length":
                raise FilterError(f"function {name} is not supported")
            self.at += 1
            field = self.take("word")
            self.take("punct", ")")
            value_op, value = self.take("op"), self.literal()
            if not isinstance(value, int) or isinstance(value, bool):
                raise FilterError("array_length compares with an integer")
            return Relation(field, value_op, value, True)
        if not _NAME.match(name):
            raise FilterError(f"{name!r} is no field name")
        word = self.peek()
        if word == "IS":
            self.at += 1
            no = self.peek() == "NOT"
            self.at += no
            self.take("word", "NULL")
            return Relation(name, "IS NOT NULL" if no else "IS NULL")
        no = word == "NOT"
        self.at += no
        word = self.peek()
        if word in ("IN", "CONTAIN_ALL", "CONTAIN_ANY"):
            self.at += 1
            return Relation(name, ("NOT " if no else "") + word, self.list())
        if no:
            raise FilterError(f"NOT can't stand before {word or 'this'}")
        if word == "LIKE":
            self.at += 1
            value = self.literal()
            if not isinstance(value, str):
                raise FilterError("LIKE takes a string")
            return Relation(name, "LIKE", value)
        op = self.take("op")
        if self.peek() == "[":
            self.at += 1
            values = []
            while self.peek() != "]":
                values.append(self.literal())
                if self.peek() == ",":
                    self.at += 1
            self.at += 1
            return Relation(name, op, tuple(float(v) for v in values))
        return Relation(name, op, self.literal())

    def list(self) -> tuple:
        self.take("punct", "(")
        out = []
        while self.peek() != ")":
            out.append(self.literal())
            if self.peek() == ",":
                self.at += 1
        self.at += 1
        return tuple(out)

    def literal(self):
        if self.at >= len(self.tokens):
            raise FilterError("a literal is missing")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\([\\'\"])", lambda m: m[1] if m[1] == v[0] else m[0], v[1:-1])
        if v.upper() in ("TRUE", "FALSE"):
            return v.upper() == "TRUE"
        if kind == "word" and _NUMBER.match(v):
            return int(v) if re.match(r"[-+]?\d+$", v) else float(v)
        raise FilterError(f"{v!r} is no literal")


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _typed(value, kind: T.DataType, field: str) -> Column:
    ok = isinstance(kind, T.StringType) and isinstance(value, str) or isinstance(kind, T.BooleanType) and isinstance(value, bool)
    if isinstance(kind, _NUMERIC) and not isinstance(value, bool):
        ok = isinstance(value, int) or isinstance(value, float) and isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        ok = True
    if not ok:
        raise FilterError(f"{value!r} doesn't fit {field} of type {kind.simpleString()}")
    return F.lit(value).cast(kind)


def _relation(r: Relation, schema: T.StructType) -> Column:
    if r.field not in schema.names:
        raise FilterError(f"no field {r.field}")
    kind, c = schema[r.field].dataType, F.col(f"`{r.field}`")
    array = isinstance(kind, T.ArrayType)
    if r.op == "IS NULL":
        return c.isNull()
    if r.op == "IS NOT NULL":
        return c.isNotNull()
    if r.length:
        if not array:
            raise FilterError(f"{r.field} is no array")
        return _COMPARE[r.op](F.when(c.isNotNull(), F.size(c)), F.lit(r.value))
    if "CONTAIN" in r.op:
        if not array:
            raise FilterError(f"{r.field} is no array")
        if len(r.value) > MAX_CONTAIN:
            raise FilterError(f"a list of more than {MAX_CONTAIN}")
        all_, no = r.op.endswith("ALL"), r.op.startswith("NOT")
        if not r.value:
            return c.isNotNull() if all_ != no else F.lit(False)
        has = [F.coalesce(F.array_contains(c, _typed(v, kind.elementType, r.field)), F.lit(False)) for v in r.value]
        found = reduce((lambda a, b: a & b) if all_ else (lambda a, b: a | b), has)
        return c.isNotNull() & (~found if no else found)
    if array:
        raise FilterError(f"{r.op} isn't for arrays")
    if r.op.endswith("IN"):
        if len(r.value) > MAX_IN:
            raise FilterError(f"a list of more than {MAX_IN}")
        if not r.value:
            return c.isNotNull() if r.op.startswith("NOT") else F.lit(False)
        found = c.isin([_typed(v, kind, r.field) for v in r.value])
        return ~found if r.op.startswith("NOT") else found
    if r.op == "LIKE":
        if not isinstance(kind, T.StringType):
            raise FilterError("LIKE is for strings")
        return c.like(r.value)
    if isinstance(kind, T.BooleanType) and r.op not in ("=", "!="):
        raise FilterError("booleans have no order")
    if isinstance(kind, T.BinaryType):
        raise FilterError("binary fields can't be filtered")
    return _COMPARE[r.op](c, _typed(r.value, kind, r.field))


@dataclass
class Compiled:
    """What a filter says: the scalar predicate, and the vector it asks for, if any."""

    predicate: Column
    vector: tuple[str, tuple[float, ...]] | None = None


def compile_filter(text: str | None, schema: T.StructType, compat: bool = False) -> Compiled:
    """compat: unequal-to relations of one field joined by OR are taken as NOT IN, as older engines did."""
    if not text or not text.strip():
        return Compiled(F.lit(True))
    vectors: list[tuple[str, tuple[float, ...]]] = []

    def walk(node, under_or: bool = False) -> Column:
        if isinstance(node, Relation):
            if isinstance(node.value, tuple) and node.op in _COMPARE:
                if node.op != "=" or under_or or vectors:
                    raise FilterError("one vector relation, with =, and not under OR")
                vectors.append((node.field, node.value))
                return F.lit(True)
            return _relation(node, schema)
        parts = node.parts
        if compat and node.op == "OR" and all(isinstance(p, Relation) and p.op == "!=" and not p.length for p in parts) and len({p.field for p in parts}) == 1:
            return _relation(Relation(parts[0].field, "NOT IN", tuple(p.value for p in parts)), schema)
        joined = [walk(p, under_or or node.op == "OR") for p in parts]
        return reduce((lambda a, b: a & b) if node.op == "AND" else (lambda a, b: a | b), joined)

    predicate = walk(parse(text))
    return Compiled(predicate, vectors[0] if vectors else None)


def scalar(text: str | None, schema: T.StructType, compat: bool = False) -> Column:
    """The predicate of a filter without a vector relation; with one, only a search can answer it."""
    compiled = compile_filter(text, schema, compat)
    if compiled.vector:
        raise FilterError(f"a vector relation on {compiled.vector[0]} needs a search")
    return compiled.predicate


def where(df, text: str | None, compat: bool = False):
    return df.where(scalar(text, df.schema, compat))
