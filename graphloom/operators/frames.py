"""Node and edge frames with prefixed columns, and unions of frames whose columns differ."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import errors
from graphloom.errors import GraphQueryError
from graphloom.functions.expressions import Entity, c, kind_of, null_of, typed, types_of
from graphloom.plans import ast as A
from graphloom.plans.usage import KEYS
from graphloom.sources.catalog import EdgeType, GraphCatalog, NodeLabel


@dataclass
class Context:
    """What a compilation needs beside the query."""

    spark: SparkSession
    catalog: GraphCatalog
    params: dict[str, Any]
    snapshot: tuple[str, int, tuple[str, ...]] | None = None
    numbers: count = field(default_factory=count)
    external: bool = False  # whether a virtual label was read
    needs: dict[str, set[str] | None] | None = None  # properties read of each variable from the present clause on; None: all
    where: A.Expr | None = None  # the condition of the present MATCH

    def prefix(self) -> str:
        return f"b{next(self.numbers)}"

    def narrowed(self, entity: Entity, name: str) -> Entity:
        """The entity with those of its properties that are read of the name from here on, so that no others are shuffled."""
        read = None if self.needs is None else self.needs.get(name, set())
        if read is None:
            return entity
        keys = self.catalog.key_columns(entity.labels) if KEYS in read else set()
        return Entity(entity.kind, entity.prefix, entity.labels, tuple(p for p in entity.props if p in read or p in keys))


def at_snapshot(rows: DataFrame, label: NodeLabel, snapshot: tuple[str, int, tuple[str, ...]] | None) -> DataFrame:
    """The rows of a virtual label that a snapshot shows.

    ``latest`` and ``ffill``: rows up to the time, of an entity key only the last one. ``nearest``: of an entity key the
    row nearest in time, the earlier of two; without an entity key all rows. Other strategies and physical labels: all.
    """
    if not snapshot or label.name not in snapshot[2] or not label.virtual or not label.time_column:
        return rows
    strategy, at, _ = snapshot
    time = c(label.time_column)
    moment = F.timestamp_millis(F.lit(at).cast("long")) if kind_of(rows.schema[label.time_column].dataType) == "time" else F.lit(at).cast("long")
    keys = [c(k) for k in label.entity_key]
    tie = c(label.id_column)
    if strategy in ("latest", "ffill"):
        rows = rows.where(time <= moment)
        order = [time.desc(), tie]
    elif strategy == "nearest" and keys:
        far = F.abs(F.unix_micros(time.cast("timestamp")) - F.unix_micros(moment)) if kind_of(rows.schema[label.time_column].dataType) == "time" else F.abs(time - moment)
        order = [far.asc_nulls_last(), time, tie]
    else:
        return rows
    if not keys:
        return rows
    return rows.withColumn("@n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c("@n") == 1).drop("@n")


def as_node(rows: DataFrame, label: NodeLabel, prefix: str, props: tuple[str, ...] | None = None) -> tuple[DataFrame, Entity]:
    own = types_of(rows)
    props = tuple(own) if props is None else props
    named = [c(p).alias(f"{prefix}:{p}") for p in props]
    types = {f"{prefix}@id": own[label.id_column], f"{prefix}@label": T.StringType()} | {f"{prefix}:{p}": own[p] for p in props}
    frame = rows.select(c(label.id_column).alias(f"{prefix}@id"), F.lit(label.name).alias(f"{prefix}@label"), *named)
    return typed(frame, types), Entity("node", prefix, (label.name,), props)


def node_frame(ctx: Context, name: str, prefix: str, read: set[str] | None) -> tuple[DataFrame, Entity]:
    """A label's rows with prefixed columns: those that are read (None: all) and those by which edges join.

    The catalog remembers them, as the same rows and prefix come again with each query.
    """
    label = ctx.catalog.label(name)
    ctx.external |= label.virtual
    rows = label.frame()
    if read is not None:
        read = read | ctx.catalog.key_columns((name,))
    props = tuple(x for x in types_of(rows) if read is None or x in read)
    if ctx.snapshot and label.virtual:
        return as_node(at_snapshot(rows, label, ctx.snapshot), label, prefix, props)
    return ctx.catalog.remembered(rows, ("node", label, prefix, props), lambda: as_node(rows, label, prefix, props))


def edge_frame(ctx: Context, edge: EdgeType, prefix: str, read: set[str] | None, with_id: bool) -> tuple[DataFrame, Entity]:
    """An edge table's rows with prefixed columns: those that are read (None: all), and an id if edges are told apart."""
    rows = edge.frame()
    props = tuple(x for x in types_of(rows) if x not in (edge.start, edge.end) and (read is None or x in read))
    return ctx.catalog.remembered(rows, ("edge", edge, prefix, props, with_id), lambda: _edge_frame(edge, rows, prefix, props, with_id))


def _edge_frame(edge: EdgeType, rows: DataFrame, prefix: str, props: tuple[str, ...], with_id: bool) -> tuple[DataFrame, Entity]:
    own = types_of(rows)
    metas = {"label": (F.lit(edge.name), T.StringType()), "start": (c(edge.start), own[edge.start]), "end": (c(edge.end), own[edge.end])}
    if with_id and edge.id_column:
        metas["id"] = c(edge.id_column), own[edge.id_column]
    elif with_id:
        # Without an id column, rows that are equal throughout are one edge: its id is the row itself, so that no two edges share one.
        metas["id"] = F.struct(*[c(x) for x in own]), T.StructType([T.StructField(x, t) for x, t in own.items()])
    types = {f"{prefix}@{k}": t for k, (_, t) in metas.items()} | {f"{prefix}:{p}": own[p] for p in props}
    frame = rows.select(*[col.alias(f"{prefix}@{k}") for k, (col, _) in metas.items()], *[c(p).alias(f"{prefix}:{p}") for p in props])
    return typed(frame, types), Entity("edge", prefix, (edge.name,), props)


def keys_equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Equality of join keys; keys of different kinds compare as text."""
    if kind_of(ta) == "other" and kind_of(tb) == "other" and ta != tb:
        return F.to_json(a) == F.to_json(b)
    return a == b if kind_of(ta) == kind_of(tb) else a.cast("string") == b.cast("string")


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        out = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            out[f.name] = common_type(out[f.name], f.dataType) if f.name in out else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in out.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    return T.StringType()


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        names = have.fieldNames()
        parts = [(as_type(col[f.name], have[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) and isinstance(want, T.StringType):
        return F.to_json(col)
    return col.cast(want)


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames by column name; a missing column is null, types that differ become the wider number or text."""
    if len(frames) == 1:
        return frames[0]
    types: dict[str, T.DataType] = {}
    for frame in frames:
        for name, kind in types_of(frame).items():
            types[name] = common_type(types[name], kind) if name in types else kind
    out = []
    for frame in frames:
        own = types_of(frame)
        same = list(own) == list(types) and all(own[n] == t for n, t in types.items())
        out.append(frame if same else frame.select(*[c(n) if own.get(n) == t else (as_type(c(n), own[n], t) if n in own else null_of(t)).alias(n) for n, t in types.items()]))
    return typed(reduce(DataFrame.union, out), types)


def merged(entities: list[Entity]) -> Entity:
    """One entity that stands for any of several with the same prefix."""
    labels, props = (tuple(dict.fromkeys(x for e in entities for x in getattr(e, what))) for what in ("labels", "props"))
    return Entity(entities[0].kind, entities[0].prefix, labels, props)


def bound_props(ctx: Context, props: A.MapOf | A.Param | None) -> tuple[tuple[str, A.Expr], ...]:
    """Inline properties as (key, value) pairs; a parameter must be a map."""
    if isinstance(props, A.Param):
        from graphloom.functions.expressions import parameter

        value = parameter(ctx.params, props.name)
        if not isinstance(value, dict):
            raise GraphQueryError(f"Parameter {props.name} must be a map", errors.EXECUTION)
        return tuple((k, A.Lit(v)) for k, v in value.items())
    return props.items if props else ()
