"""WITH and RETURN: projection, aggregation, DISTINCT, ORDER BY, LIMIT."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import errors
from graphloom.errors import GraphQueryError, SyntaxRejected
from graphloom.functions.expressions import Compiler, Entity, PathOf, Scalar, Scope, c, kind_of, typed, types_of
from graphloom.operators.frames import Context
from graphloom.plans import ast as A


def id_column(e: Entity, types: dict[str, T.DataType]) -> Column:
    """An entity's id to show; the id of an edge without an id column is its row, of which a hash is shown."""
    return F.xxhash64(e.meta("id")) if isinstance(types.get(f"{e.prefix}@id"), T.StructType) else e.meta("id")


def path_column(path: PathOf, project: dict[str, tuple[str, ...]], types: dict[str, T.DataType]) -> Column:
    """A path as an array of (type, label, id, props), props as JSON and empty for edges."""
    steps = []
    for e in path.steps:
        props = [e.col(p).alias(p) for p in e.props if e.kind == "node" and _shown(e, p, project)]
        json = F.to_json(F.struct(*props)) if props else F.lit("{}")
        steps.append(F.struct(F.lit(e.kind).alias("type"), e.meta("label").alias("label"), id_column(e, types).cast("string").alias("id"), json.alias("props")))
    return F.array(*steps)


def _shown(e: Entity, prop: str, project: dict[str, tuple[str, ...]]) -> bool:
    return any(label not in project or prop in project[label] for label in e.labels)


def entity_column(e: Entity, project: dict[str, tuple[str, ...]], types: dict[str, T.DataType]) -> Column:
    """An entity as a struct. A label that PROJECT BY lists shows its listed fields and the label only."""

    def field(name: str, col: Column, kind: T.DataType) -> Column:
        hidden = [x for x in e.labels if x in project and name not in project[x]]
        return (F.when(~e.meta("label").isin(hidden), col).otherwise(F.lit(None).cast(kind)) if hidden else col).alias(name)

    if e.kind == "edge":
        props = [field(p, e.col(p), types[f"{e.prefix}:{p}"]) for p in e.props if _shown(e, p, project)]
        body = [F.struct(*props).alias("properties")] if props else []
        return F.struct(id_column(e, types).alias("id"), e.meta("label").alias("type"), e.meta("start").alias("startNodeId"), e.meta("end").alias("endNodeId"), *body)
    taken = {"id", "label"}
    parts = [field("id", e.meta("id"), types[f"{e.prefix}@id"])] if _shown(e, "id", project) else []
    parts.append(e.meta("label").alias("label"))
    for p in e.props:
        if p.lower() not in taken and _shown(e, p, project):
            taken.add(p.lower())
            parts.append(field(p, e.col(p), types[f"{e.prefix}:{p}"]))
    return F.struct(*parts)


def _aggregate(ctx: Context, scope: Scope, items: list[A.Item], order: list[A.Expr]) -> tuple[Scope, list[A.Item]]:
    """The scope after grouping by the items without aggregates; aggregates and keys are known columns of it.

    A node or edge as a key stands for its id and label. Properties of it that are read later are keys too, as they follow
    from the id; rows that share an id but differ in such properties are groups of their own.
    """
    compile_ = Compiler(scope, ctx.params)
    keys = [i for i in items if not A.has_aggregate(i.expr)]
    aggs = list(dict.fromkeys(x for e in [*(i.expr for i in items), *order] for x in A.walk(e) if isinstance(x, A.Agg)))
    columns: dict[str, Column] = {}
    group: list[str] = []
    known: dict[A.Expr, str] = {}
    names: dict[str, Entity | Scalar | PathOf] = {}
    for item in keys:
        own = scope.vars.get(item.expr.name) if isinstance(item.expr, A.Var) else None
        if isinstance(own, Entity):
            own = ctx.narrowed(own, item.name)
            group += [x for x in own.columns if x in scope.types()]
            names[item.expr.name] = own
            continue
        name = f"{ctx.prefix()}@key"
        columns[name] = path_column(own, {}, scope.types()) if isinstance(own, PathOf) else compile_(item.expr)[0]
        group.append(name)
        known[item.expr] = name
    results = []
    for agg in aggs:
        name, arg = f"{ctx.prefix()}@agg", f"{ctx.prefix()}@arg"
        if agg.arg is not None:
            col, kind = compile_(agg.arg)
            if agg.name in ("sum", "avg") and kind_of(kind) not in ("number", "none"):
                raise GraphQueryError(f"{agg.name} needs numbers", errors.EXECUTION)
            columns[arg] = col
            whole = isinstance(kind, T.IntegralType)
        if agg == A.Agg("count", None) and scope.times:
            results.append(F.coalesce(F.sum(c(scope.times)), F.lit(0).cast("long")).alias(name))
        else:
            results.append(_function(agg, arg, agg.arg is not None and whole).alias(name))
        known[agg] = name
    group = list(dict.fromkeys(group))
    frame = scope.frame.withColumns(columns) if columns else scope.frame
    frame = frame.groupBy(*[c(x) for x in group]).agg(*results)
    return Scope(frame, names, known), items


def _function(agg: A.Agg, arg: str, whole: bool) -> Column:
    match agg.name, agg.distinct:
        case "count", False:
            return F.count(F.lit(1)) if agg.arg is None else F.count(c(arg))
        case "count", True:
            return F.count_distinct(c(arg))
        case "sum", distinct:
            total = F.sum_distinct(c(arg)) if distinct else F.sum(c(arg))
            return F.coalesce(total, F.lit(0).cast("long") if whole else F.lit(0.0))
        case "avg", distinct:
            return F.expr(f"avg({'distinct ' if distinct else ''}`{arg}`)").cast("double")
        case "min", _:
            return F.min(c(arg))
        case "max", _:
            return F.max(c(arg))
    raise SyntaxRejected(f"Unsupported function: {agg.name}")


def limit_of(ctx: Context, e: A.Expr) -> int:
    from graphloom.functions.expressions import parameter

    value = e.value if isinstance(e, A.Lit) else parameter(ctx.params, e.name) if isinstance(e, A.Param) else None
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise SyntaxRejected("LIMIT needs a whole number that is not negative")
    return value


def project(ctx: Context, scope: Scope | None, p: A.Projection, final: bool = False) -> tuple[Scope, list[str]]:
    """The scope after a WITH or RETURN, and its names in order. ``final``: values get the names that they are shown by."""
    if scope is None:
        raise SyntaxRejected("A query begins with MATCH")
    items = [A.Item(A.Var(v), v) for v in scope.vars] if p.star else []
    items += p.items
    if any(A.has_aggregate(i.expr) for i in items):
        scope, items = _aggregate(ctx, scope, items, [s.expr for s in p.order])
    compile_ = Compiler(scope, ctx.params)
    columns: dict[str, Column] = {}
    kinds: dict[str, T.DataType] = {}
    out: dict[str, Entity | Scalar | PathOf] = {}
    for item in items:
        own = scope.vars.get(item.expr.name) if isinstance(item.expr, A.Var) and item.expr not in scope.known else None
        if isinstance(own, Entity):
            out[item.name] = ctx.narrowed(own, item.name)
        elif isinstance(own, PathOf):
            out[item.name] = own
        else:
            alone = "`" not in item.name and sum(i.name.lower() == item.name.lower() for i in items) == 1
            name = item.name if final and alone else f"{ctx.prefix()}@value"
            col, kind = compile_(item.expr)
            kinds[name] = T.StringType() if isinstance(kind, T.NullType) else kind
            columns[name] = col.cast("string") if isinstance(kind, T.NullType) else col
            out[item.name] = Scalar(name)
    returned = {i.expr.name for i in items if isinstance(i.expr, A.Var)} | {k for k, v in out.items() if isinstance(v, Entity)}
    # sort keys: an item's name or expression, else what the rows had before
    after = Scope(scope.frame, {**scope.vars, **{k: v for k, v in out.items() if isinstance(v, Entity)}}, dict(scope.known))
    hidden = []
    for k, sort in enumerate(p.order):
        same = next((i.name for i in items if isinstance(sort.expr, A.Var) and sort.expr.name == i.name), None)
        same = same or next((i.name for i in items if i.expr == sort.expr), None)
        target = out[same] if same else None
        if isinstance(target, Scalar):
            name = target.column
        else:
            if p.distinct and not set(A.variables(sort.expr)) <= returned:
                raise SyntaxRejected("ORDER BY after DISTINCT needs a returned value")
            name = f"{ctx.prefix()}@sort{k}"
            e = A.Var(same) if isinstance(target, Entity) else sort.expr
            columns[name], kinds[name] = Compiler(after, ctx.params)(e)
        hidden.append((name, sort.ascending))
    have = types_of(scope.frame) | kinds
    kept = [x for x in dict.fromkeys(x for v in out.values() for x in _columns(v)) if x in have]
    frame = scope.frame

    def some(names: list[str]) -> DataFrame:
        return frame.select(*[columns[x].alias(x) if x in columns else c(x) for x in dict.fromkeys(names)])

    if p.distinct:  # rows that agree in ids and labels agree in properties, and sort keys follow from what is returned
        frame = some([*kept, *(n for n, _ in hidden)]).distinct()
    elif hidden:
        frame = some([*kept, *(n for n, _ in hidden)])
    else:
        frame = some(kept)
    if hidden:
        frame = frame.orderBy(*[c(n).asc_nulls_last() if up else c(n).desc_nulls_first() for n, up in hidden])
    if p.limit is not None:
        frame = frame.limit(limit_of(ctx, p.limit))
    if any(n not in kept for n, _ in hidden):
        frame = frame.select(*[c(x) for x in kept])
    result = Scope(typed(frame, {x: have[x] for x in kept}), out)
    if p.where is not None:
        result.where(Compiler(result, ctx.params).truth(p.where))
    return result, list(out)


def _columns(v: Entity | Scalar | PathOf) -> list[str]:
    if isinstance(v, Scalar):
        return [v.column]
    return v.columns if isinstance(v, Entity) else [x for s in v.steps for x in s.columns]


def shown(scope: Scope, names: list[str], by_label: dict[str, tuple[str, ...]]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with a column for each name (entities as structs, paths as arrays), and what kind each is."""
    kinds = {name: {Entity: "entity", PathOf: "path", Scalar: "value"}[type(scope.vars[name])] for name in names}
    if set(kinds.values()) == {"path"}:  # equal paths count once; their columns are compared before anything is rendered
        own = list(dict.fromkeys(x for name in names for x in _columns(scope.vars[name]) if x in scope.types()))
        scope.frame = typed(scope.frame.select(*[c(x) for x in own]).distinct(), {x: scope.types()[x] for x in own})
    types, columns = scope.types(), []
    for name in names:
        own = scope.vars[name]
        if isinstance(own, Entity):
            columns.append(entity_column(own, by_label, types).alias(name))
            kinds[name] = own.kind
        elif isinstance(own, PathOf):
            columns.append(path_column(own, by_label, types).alias(name))
        else:
            columns.append(c(own.column) if own.column == name else c(own.column).alias(name))
    if list(types) == names and all(kinds[n] == "value" and scope.vars[n].column == n for n in names):
        return scope.frame, kinds
    return scope.frame.select(*columns), kinds
