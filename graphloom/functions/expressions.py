"""Expressions of the query language as Columns, with three-valued logic and no implicit casts."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import errors
from graphloom.errors import GraphQueryError, SyntaxRejected
from graphloom.plans import ast as A


_columns: dict[str, Column] = {}
_columns_of: list[SparkContext | None] = [None]


def _remembered(key: str, make: Callable[[], Column]) -> Column:
    """Columns are remembered as long as the context lives, since making one is some calls to the JVM."""
    if _columns_of[0] is not SparkContext._active_spark_context or len(_columns) > 10_000:
        _columns.clear()
        _columns_of[0] = SparkContext._active_spark_context
    if key not in _columns:
        _columns[key] = make()
    return _columns[key]


def c(name: str) -> Column:
    """The column of a name."""
    return _remembered(name, lambda: F.col(f"`{name}`"))


def null_of(kind: T.DataType) -> Column:
    """Null of a type."""
    return _remembered(f"null {kind.simpleString()}", lambda: F.lit(None).cast(kind))


def text(value: str) -> Column:
    """A text that queries have again and again, such as the name of a label."""
    return _remembered(f"text {value}", lambda: F.lit(value))


def types_of(frame: DataFrame) -> dict[str, T.DataType]:
    """Types by column name. They are kept with the frame, as reading a schema is a call to the JVM."""
    found = frame.__dict__.get("_column_types")
    if found is None:
        found = frame.__dict__["_column_types"] = {f.name: f.dataType for f in frame.schema.fields}
    return found


def typed(frame: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """The frame, whose types are known already."""
    frame.__dict__["_column_types"] = types
    return frame


@dataclass(frozen=True)
class Entity:
    """A node or edge that a row binds, as flat columns ``<prefix>:<property>`` and ``<prefix>@id`` etc."""

    kind: str  # node, edge
    prefix: str
    labels: tuple[str, ...]
    props: tuple[str, ...]

    def col(self, prop: str) -> Column:
        return c(f"{self.prefix}:{prop}")

    def meta(self, what: str) -> Column:
        return c(f"{self.prefix}@{what}")

    @property
    def metas(self) -> tuple[str, ...]:
        return ("id", "label") if self.kind == "node" else ("id", "label", "start", "end")

    @property
    def columns(self) -> list[str]:
        return [f"{self.prefix}@{m}" for m in self.metas] + [f"{self.prefix}:{p}" for p in self.props]


@dataclass(frozen=True)
class Scalar:
    column: str


@dataclass(frozen=True)
class PathOf:
    """A path by the entities along it, in written order."""

    steps: tuple[Entity, ...]


@dataclass
class Scope:
    """A DataFrame of binding rows and what its variables stand for."""

    frame: DataFrame
    vars: dict[str, Entity | Scalar | PathOf] = field(default_factory=dict)
    known: dict[A.Expr, str] = field(default_factory=dict)  # expressions that are columns already
    times: str | None = None  # the column that says for how many binding rows a row stands; None: for one

    def types(self) -> dict[str, T.DataType]:
        return types_of(self.frame)

    def where(self, test: Column) -> None:
        self.frame = typed(self.frame.where(test), types_of(self.frame))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "truth"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "none" if isinstance(t, T.NullType) else "other"


def literal(value: Any) -> tuple[Column, T.DataType]:
    match value:
        case None:
            return F.lit(None), T.NullType()
        case bool():
            return F.lit(value), T.BooleanType()
        case int():
            fits = -(1 << 63) <= value < 1 << 63
            return (F.lit(value).cast("long"), T.LongType()) if fits else (F.lit(float(value)), T.DoubleType())
        case float():
            return F.lit(value), T.DoubleType()
        case str():
            return F.lit(value), T.StringType()
        case list() | tuple():
            parts = [literal(v) for v in value]
            inner = next((t for _, t in parts if not isinstance(t, T.NullType)), T.StringType())
            return F.array(*[p for p, _ in parts]).cast(T.ArrayType(inner)), T.ArrayType(inner)
        case dict():
            parts = {k: literal(v) for k, v in value.items()}
            return F.struct(*[p.alias(k) for k, (p, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
    if hasattr(value, "isoformat"):
        out = F.lit(value)
        return out, T.TimestampType() if hasattr(value, "hour") else T.DateType()
    raise GraphQueryError(f"Value of type {type(value).__name__} cannot be used in a query", errors.EXECUTION)


def parameter(params: dict[str, Any], name: str) -> Any:
    for key in (name, int(name) if name.isdigit() else None):
        if key in params:
            return params[key]
    raise GraphQueryError(f"Missing parameter: {name}", errors.EXECUTION)


def _never(*cols: Column) -> Column:
    """False where all are known, null elsewhere."""
    return F.when(reduce(or_, [x.isNull() for x in cols]), F.lit(None).cast("boolean")).otherwise(F.lit(False))


_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _as_time(col: Column, kind: str) -> Column:
    return F.timestamp_millis(col.cast("long")) if kind == "number" else F.try_to_timestamp(col) if kind == "text" else col


def compare(op: str, a: tuple[Column, T.DataType], b: tuple[Column, T.DataType]) -> Column:
    """Values of different kinds are unequal, and neither less nor greater; a time compares with epoch milliseconds and with text that reads as a time."""
    (x, tx), (y, ty) = a, b
    kx, ky = kind_of(tx), kind_of(ty)
    if "none" in (kx, ky):
        return F.lit(None).cast("boolean")
    if "time" in (kx, ky) and kx != ky and {kx, ky} <= {"time", "number", "text"}:
        x, y = _as_time(x, kx), _as_time(y, ky)
    elif kx != ky or (kx == "other" and tx != ty):
        return _never(x, y) if op == "=" else ~_never(x, y) if op == "<>" else F.lit(None).cast("boolean")
    return _COMPARE[op](x, y)


class Compiler:
    """Compiles expressions in a scope."""

    def __init__(self, scope: Scope, params: dict[str, Any], allow_aggregates: bool = False):
        self.scope, self.params = scope, params

    @property
    def types(self) -> dict[str, T.DataType]:
        return self.scope.types()

    def truth(self, e: A.Expr) -> Column:
        col, t = self(e)
        if kind_of(t) not in ("truth", "none"):
            raise SyntaxRejected("A condition must be true or false")
        return col if kind_of(t) == "truth" else col.cast("boolean")

    def value(self, e: A.Expr) -> Any:
        """The value of an expression that refers to no row; raises for others."""
        match e:
            case A.Lit(v):
                return v
            case A.Param(name):
                return parameter(self.params, name)
            case A.ListOf(items):
                return [self.value(x) for x in items]
            case A.MapOf(items):
                return {k: self.value(x) for k, x in items}
        raise LookupError

    def __call__(self, e: A.Expr) -> tuple[Column, T.DataType]:
        if e in self.scope.known if _hashable(e) else False:
            name = self.scope.known[e]
            return c(name), self.types[name]
        match e:
            case A.Lit() | A.Param() | A.ListOf() | A.MapOf():
                try:
                    return literal(self.value(e))
                except LookupError:
                    return self._built(e)
            case A.Var(name):
                return self._variable(name)
            case A.Prop(of, key):
                return self._property(of, key)
            case A.HasLabels(of, labels):
                entity = self._entity(of)
                tests = [entity.meta("label") == F.lit(x) for x in labels]
                return reduce(and_, tests), T.BooleanType()
            case A.Compare(op, left, right):
                return compare(op, self(left), self(right)), T.BooleanType()
            case A.Logic(op, items):
                return reduce(and_ if op == "AND" else or_, [self.truth(x) for x in items]), T.BooleanType()
            case A.Not(of):
                return ~self.truth(of), T.BooleanType()
            case A.IsNull(of, negated):
                col = self(of)[0]
                return (col.isNotNull() if negated else col.isNull()), T.BooleanType()
            case A.TextMatch(op, of, what):
                (x, tx), (y, ty) = self(of), self(what)
                if kind_of(tx) != "text" or kind_of(ty) != "text":
                    return F.lit(None).cast("boolean"), T.BooleanType()
                return {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](x, y), T.BooleanType()
            case A.In(of, among):
                return self._among(of, among), T.BooleanType()
            case A.Agg():
                raise SyntaxRejected("Aggregation is not allowed here")
        raise SyntaxRejected("Unsupported expression")

    def _built(self, e: A.Expr) -> tuple[Column, T.DataType]:
        if isinstance(e, A.ListOf):
            parts = [self(x) for x in e.items]
            return F.array(*[x for x, _ in parts]), T.ArrayType(parts[0][1])
        parts = {k: self(v) for k, v in e.items}
        return F.struct(*[x.alias(k) for k, (x, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])

    def _entity(self, e: A.Expr) -> Entity:
        own = self.scope.vars.get(e.name) if isinstance(e, A.Var) else None
        if not isinstance(own, Entity):
            raise SyntaxRejected("Labels are tested on nodes and relationships only")
        return own

    def _variable(self, name: str) -> tuple[Column, T.DataType]:
        match self.scope.vars.get(name):
            case Entity() as x:
                return x.meta("id"), self.types[f"{x.prefix}@id"]
            case Scalar(column):
                return c(column), self.types[column]
            case PathOf():
                raise SyntaxRejected(f"Path `{name}` can only be returned")
        raise SyntaxRejected(f"Variable `{name}` not defined")

    def _property(self, of: A.Expr, key: str) -> tuple[Column, T.DataType]:
        own = self.scope.vars.get(of.name) if isinstance(of, A.Var) else None
        if isinstance(of, A.Var) and own is None:
            raise SyntaxRejected(f"Variable `{of.name}` not defined")
        if isinstance(own, Entity):
            if key in own.props:
                return own.col(key), self.types[f"{own.prefix}:{key}"]
            if key in ("id", "_id"):
                return own.meta("id"), self.types[f"{own.prefix}@id"]
            if key == "label":
                return own.meta("label"), T.StringType()
            return F.lit(None), T.NullType()
        col, t = self(of)
        if isinstance(t, T.StructType) and key in t.fieldNames():
            return col[key], t[key].dataType
        if isinstance(t, T.MapType):
            return col[key], t.valueType
        return F.lit(None), T.NullType()

    def _among(self, of: A.Expr, among: A.Expr) -> Column:
        x = self(of)
        try:
            values = self.value(among)
        except LookupError:
            if isinstance(among, A.ListOf):
                return reduce(or_, [compare("=", x, self(v)) for v in among.items])
            col, t = self(among)
            if not isinstance(t, T.ArrayType) or kind_of(t.elementType) != kind_of(x[1]):
                return _never(x[0], col)
            return F.array_contains(col, x[0])
        if not isinstance(values, (list, tuple)):
            raise SyntaxRejected("IN needs a list")
        fitting = [v for v in values if v is not None and kind_of(literal(v)[1]) == kind_of(x[1])]
        if kind_of(x[1]) == "time":
            return reduce(or_, [compare("=", x, literal(v)) for v in values], F.lit(False))
        out = x[0].isin(fitting) if fitting else _never(x[0]) if values else F.lit(False)
        return out | F.lit(None).cast("boolean") if None in values else out


def _hashable(e: A.Expr) -> bool:
    try:
        hash(e)
    except TypeError:
        return False
    return True
