"""Graph patterns as joins."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import errors
from graphloom.errors import GraphQueryError, SyntaxRejected
from graphloom.functions.expressions import Compiler, Entity, PathOf, Scope, c, text, typed, types_of
from graphloom.operators.frames import Context, as_node, at_snapshot, bound_props, edge_frame, keys_equal, merged, node_frame, union
from graphloom.plans import ast as A
from graphloom.plans.usage import KEYS, conditions
from graphloom.sources.catalog import ID, EdgeType, NodeLabel, VirtualEdge
from graphloom.sources.lookup import LookupSource, Request


def _filtered(ctx: Context, frame: DataFrame, entity: Entity, props: A.MapOf | A.Param | None) -> DataFrame:
    pairs = bound_props(ctx, props)
    if not pairs:
        return frame
    scope = Scope(frame, {"@own": entity})
    for key, value in pairs:
        scope.where(Compiler(scope, ctx.params).truth(A.Compare("=", A.Prop(A.Var("@own"), key), value)))
    return scope.frame


def _of_labels(ctx: Context, frame: DataFrame, entity: Entity, labels: tuple[str, ...]) -> DataFrame:
    """Keeps the nodes that also have the other labels: those whose id stands under each of them."""
    for other in labels:
        if other not in entity.labels:
            prefix = ctx.prefix()
            ids = node_frame(ctx, other, prefix, set())[0]
            frame = typed(frame.join(ids, c(f"{entity.prefix}@id") == c(f"{prefix}@id"), "left_semi"), types_of(frame))
    return frame


def _scan(ctx: Context, node: A.Node, whole: bool) -> tuple[DataFrame, Entity]:
    if _lookup(ctx, node.labels[0]):
        label = ctx.catalog.label(node.labels[0])
        ctx.external = True
        request = _request(ctx, label, node, whole, "", ())
        frame, entity = as_node(at_snapshot(label.rows.search(ctx.spark, request), label, ctx.snapshot), label, ctx.prefix())
    else:
        frame, entity = node_frame(ctx, node.labels[0], ctx.prefix(), _read_of(ctx, node, whole))
    return _filtered(ctx, _of_labels(ctx, frame, entity, node.labels), entity, node.props), entity


def _read_of(ctx: Context, part: A.Node | A.Rel, whole: bool) -> set[str] | None:
    """The properties of a node or edge that the query reads; None for all."""
    if whole or ctx.needs is None:
        return None
    read = ctx.needs.get(part.var, set()) if part.var else set()
    return None if read is None else read | {k for k, _ in bound_props(ctx, part.props)}


def _lookup(ctx: Context, label: str) -> LookupSource | None:
    rows = ctx.catalog.labels[label].rows if label in ctx.catalog.labels else None
    return rows if isinstance(rows, LookupSource) else None


def _told(ctx: Context, label: NodeLabel, node: A.Node) -> tuple[tuple[str, str, object], ...]:
    """The conditions on a node that its source can be told: inline properties and those of the WHERE that must hold."""
    scope = Scope(None)
    found = [(k, "=", v) for k, v in bound_props(ctx, node.props)] + conditions(ctx.where, node.var)
    columns = label.rows.fields().fieldNames()
    out = []
    for key, op, value in found:
        key = label.id_column if key in ("id", "_id") and key not in columns else key
        if key in columns:
            out.append((key, op, Compiler(scope, ctx.params).value(value)))
    return tuple(out)


def _request(ctx: Context, label: NodeLabel, node: A.Node, whole: bool, operator: str, output: tuple[str, ...], keys: tuple[str, ...] = ()) -> Request:
    """What a lookup label is asked for, beside keys. ``output``: the columns that stand for all of them where a node is read as a whole."""
    filters = _told(ctx, label, node)
    read = _read_of(ctx, node, whole)
    if read is not None and KEYS in read:
        read = None
    if read is None and output:
        read = set(output)
    needed = {label.id_column, label.rows.key, label.time_column, *label.entity_key, *keys, *(f[0] for f in filters)}
    ordered = () if read is None else tuple(n for n in label.rows.fields().fieldNames() if n in read | needed)
    snapshot = ctx.snapshot[:2] if ctx.snapshot and label.name in ctx.snapshot[2] else None
    return Request(label.rows.key, None, filters, ordered, operator, snapshot)


class _Hop:
    """One step from a bound node over a relationship to a next node; the union of all edge types and directions that fit.

    Without ``with_edge`` nobody reads the edge of a foreign key or virtual edge, so its columns are left out.
    """

    def __init__(self, ctx: Context, frame: DataFrame, left: Entity, rel: A.Rel, right: A.Node, backwards: bool, with_edge: bool, whole: bool):
        self.ctx, self.frame, self.left, self.rel, self.right = ctx, frame, left, rel, right
        self.with_edge, self.whole = with_edge or rel.props is not None, whole
        self.edge_prefix, self.node_prefix = ctx.prefix(), ctx.prefix()
        ways = {"out": (False,), "in": (True,), "both": (False, True)}[rel.direction]
        self.ways = tuple(w != backwards for w in ways)  # True: the edge leads from right to left
        for label in right.labels:
            ctx.catalog.label(label)

    def run(self) -> tuple[DataFrame, Entity, Entity]:
        found: list[tuple[DataFrame, Entity, Entity]] = []
        types = self.rel.types or tuple(self.ctx.catalog.edges)
        for name in dict.fromkeys(types):
            self.ctx.catalog.check_edge(name)
            for into in self.ways:
                for edge in self.ctx.catalog.edges.get(name, ()):
                    found += self._physical(edge, into)
                if name in self.ctx.catalog.virtual_edges:
                    found += self._virtual(self.ctx.catalog.virtual_edges[name], into)
        if not found:  # no edge joins such labels
            edge, node = Entity("edge", self.edge_prefix, tuple(types), ()), Entity("node", self.node_prefix, self.right.labels, ())
            nothing = {x: F.lit(None).cast("string") for x in edge.columns + node.columns}
            return self.frame.where(F.lit(False)).withColumns(nothing), edge, node
        return union([x[0] for x in found]), merged([x[1] for x in found]), merged([x[2] for x in found])

    def _from(self, label: str) -> DataFrame:
        return self.frame if self.left.labels == (label,) else typed(self.frame.where(self.left.meta("label") == label), types_of(self.frame))

    def _to(self, label: str) -> tuple[DataFrame, Entity]:
        frame, node = node_frame(self.ctx, label, self.node_prefix, _read_of(self.ctx, self.right, self.whole))
        return _filtered(self.ctx, _of_labels(self.ctx, frame, node, self.right.labels), node, self.right.props), node

    def _fits(self, left: str, right: str) -> bool:
        return left in self.left.labels and (not self.right.labels or right in self.right.labels)

    def _physical(self, edge: EdgeType, into: bool) -> list[tuple[DataFrame, Entity, Entity]]:
        here, there = (edge.end_label, edge.start_label) if into else (edge.start_label, edge.end_label)
        if not self._fits(here, there):
            return []
        left, (right, node) = self._from(here), self._to(there)
        start, end = (node, self.left) if into else (self.left, node)
        types = types_of(left) | types_of(right)

        def same(a: str, b: str):
            return keys_equal(c(a), types[a], c(b), types[b])

        if edge.rows is None:
            owner, other = (start, end) if edge.owner == "start" else (end, start)
            if edge.key not in owner.props:
                raise GraphQueryError(f"Label {owner.labels} has no column {edge.key}", errors.METADATA_INVALID)
            out = typed(left.join(right, same(f"{owner.prefix}:{edge.key}", f"{other.prefix}@id")), types)
            out, own = self._edge_of(out, edge.name, owner, start, end)
        else:
            rows, own = edge_frame(self.ctx, edge, self.edge_prefix, _read_of(self.ctx, self.rel, self.whole), self.with_edge)
            rows = _filtered(self.ctx, rows, own, self.rel.props)
            types |= types_of(rows)
            near, far = ("end", "start") if into else ("start", "end")
            out = left.join(rows, same(f"{self.left.prefix}@id", f"{own.prefix}@{near}")).join(right, same(f"{own.prefix}@{far}", f"{node.prefix}@id"))
            out = typed(out, types)
        if into and len(self.ways) == 2 and here == there:  # a loop counts once
            out = typed(out.where(~self.left.meta("id").eqNullSafe(node.meta("id"))), types_of(out))
        return [(out, own, node)]

    def _edge_of(self, out: DataFrame, name: str, owner: Entity | None, start: Entity, end: Entity) -> tuple[DataFrame, Entity]:
        """The rows with an edge that has no table: its id is the owner's, or start and end."""
        own = Entity("edge", self.edge_prefix, (name,), ())
        if not self.with_edge:
            return out, own
        types = types_of(out)
        pair = F.concat_ws("->", start.meta("id").cast("string"), end.meta("id").cast("string"))
        metas = {"id": owner.meta("id") if owner else pair, "label": text(name), "start": start.meta("id"), "end": end.meta("id")}
        kinds = {"id": types[f"{owner.prefix}@id"] if owner else T.StringType(), "label": T.StringType(), "start": types[f"{start.prefix}@id"], "end": types[f"{end.prefix}@id"]}
        more = typed(out.withColumns({f"{own.prefix}@{k}": v for k, v in metas.items()}), types | {f"{own.prefix}@{k}": v for k, v in kinds.items()})
        return _filtered(self.ctx, more, own, self.rel.props), own

    def _virtual(self, edge: VirtualEdge, into: bool) -> list[tuple[DataFrame, Entity, Entity]]:
        self.ctx.external = True
        from_virtual = edge.first_hop_only != into  # whether the virtual side is on the left
        if from_virtual:
            if edge.target_label not in self.left.labels:
                return []
            labels = self.right.labels[:1] or ((edge.physical_label,) if edge.physical_label else ())
            if not labels:
                raise SyntaxRejected(f"The node beyond virtual edge '{edge.name}' must declare a label")
            here, there = edge.target_label, labels[0]
        else:
            here, there = edge.physical_label, edge.target_label
            if self.right.labels and there not in self.right.labels or here and here not in self.left.labels:
                return []
        if edge.physical_label and (there if from_virtual else here) != edge.physical_label:
            return []
        left = self._from(here) if here else self.frame
        if _lookup(self.ctx, there):
            return [self._looked_up(edge, left, there)]
        right, node = self._to(there)
        return [self._joined(edge, left, right, node, from_virtual, into)]

    def _joined(self, edge: VirtualEdge, left: DataFrame, right: DataFrame, node: Entity, from_virtual: bool, into: bool) -> tuple[DataFrame, Entity, Entity]:
        types = types_of(left) | types_of(right)
        physical, virtual = (node, self.left) if from_virtual else (self.left, node)
        keys = [(self._key(physical, mine), self._key(virtual, theirs)) for mine, theirs in edge.mapping]
        out = typed(left.join(right, reduce(and_, [keys_equal(c(a), types[a], c(b), types[b]) for a, b in keys])), types)
        start, end = (node, self.left) if into else (self.left, node)
        out, own = self._edge_of(out, edge.name, None, start, end)
        return out, own, node

    def _looked_up(self, edge: VirtualEdge, left: DataFrame, there: str) -> tuple[DataFrame, Entity, Entity]:
        """The rows of a lookup source for the distinct keys on the left, then an ordinary join."""
        label = self.ctx.catalog.label(there)
        mine = next((a for a, b in edge.mapping if b == label.rows.key or b == ID and label.id_column == label.rows.key), None)
        if mine is None:
            raise GraphQueryError(f"Virtual edge {edge.name} does not map the key {label.rows.key} of its lookup source", errors.METADATA_INVALID)
        theirs = tuple(b for _, b in edge.mapping if b != ID)
        request = _request(self.ctx, label, self.right, self.whole, edge.operator, edge.output_fields, theirs)
        rows = at_snapshot(label.rows.rows(left.select(c(self._key(self.left, mine)).alias("key")), request), label, self.ctx.snapshot)
        right, node = as_node(rows, label, self.node_prefix)
        right = _filtered(self.ctx, right, node, self.right.props)
        return self._joined(edge, left, right, node, False, self.ways[0])

    def _key(self, entity: Entity, column: str) -> str:
        if column == ID:
            return f"{entity.prefix}@id"
        if column not in entity.props:
            raise GraphQueryError(f"Label {', '.join(entity.labels)} has no column {column}", errors.METADATA_INVALID)
        return f"{entity.prefix}:{column}"


def _start(ctx: Context, path: A.Path) -> int:
    """The node that a path is built from: a searchable lookup label with an equality, else the first label that can be scanned, else any searchable one."""
    named = [(i, n, _lookup(ctx, n.labels[0])) for i, n in enumerate(path.nodes) if n.labels]
    for i, n, source in named:
        if source and source.searchable and any(op == "=" for _, op, _ in _told(ctx, ctx.catalog.label(n.labels[0]), n)):
            return i
    for i, _, source in sorted(named, key=lambda x: (bool(x[2]), x[0])):
        if not source or source.searchable:
            return i
    raise GraphQueryError("A pattern needs a node whose label can be scanned", errors.EXTERNAL_SOURCE)


def _with_path(ctx: Context, scope: Scope | None, path: A.Path, shared: bool) -> tuple[Scope, list[tuple[A.Rel, Entity]]]:
    """The scope joined with a path. ``shared``: whether its edges are compared with each other or with those of other paths."""
    bound = scope.vars if scope else {}
    start = next((i for i, n in enumerate(path.nodes) if n.var and isinstance(bound.get(n.var), Entity)), None)
    joined, whole = start is not None, path.var is not None or ctx.needs is None
    if joined:
        frame, first = scope.frame, bound[path.nodes[start].var]
        node = path.nodes[start]
        if node.labels and set(node.labels) != set(first.labels):
            frame = typed(frame.where(first.meta("label").isin(list(node.labels))), types_of(frame))
        frame = _filtered(ctx, frame, first, node.props)
    else:
        start = _start(ctx, path)
        frame, first = _scan(ctx, path.nodes[start], whole)
    names = dict(bound) if joined else {}
    nodes: dict[int, Entity] = {start: first}
    rels: dict[int, Entity] = {}
    if path.nodes[start].var:
        names.setdefault(path.nodes[start].var, first)
    order = [(i, i, i + 1, False) for i in range(start, len(path.rels))] + [(i, i + 1, i, True) for i in reversed(range(start))]
    for i, here, there, backwards in order:
        rel, node = path.rels[i], path.nodes[there]
        if rel.var and rel.var in {**bound, **names}:
            raise SyntaxRejected(f"Relationship variable `{rel.var}` is bound more than once")
        frame, edge, found = _Hop(ctx, frame, nodes[here], rel, node, backwards, whole or bool(rel.var) or shared, whole).run()
        old = names.get(node.var) if node.var else None
        if isinstance(old, Entity):
            types = types_of(frame)
            same_id = keys_equal(old.meta("id"), types[f"{old.prefix}@id"], found.meta("id"), types[f"{found.prefix}@id"])
            frame = frame.where(same_id & (old.meta("label") == found.meta("label"))).drop(*found.columns)
            frame = typed(frame, {k: v for k, v in types.items() if k not in found.columns})
            found = old
        elif old is not None:
            raise SyntaxRejected(f"Variable `{node.var}` is not a node")
        elif node.var:
            names[node.var] = found
        rels[i], nodes[there] = edge, found
        if rel.var:
            names[rel.var] = edge
    if scope and not joined:
        frame, names = typed(scope.frame.crossJoin(frame), types_of(scope.frame) | types_of(frame)), {**bound, **names}
    if path.var:
        if path.var in names:
            raise SyntaxRejected(f"Variable `{path.var}` is already bound")
        steps = [x for i in range(len(path.nodes)) for x in ([nodes[i], rels[i]] if i in rels else [nodes[i]])]
        names[path.var] = PathOf(tuple(steps))
    return Scope(frame, names), [(path.rels[i], e) for i, e in rels.items()]


def _may_meet(rels: list[A.Rel]) -> bool:
    """Whether two relationships of a MATCH could be the same edge."""
    types = [set(r.types) for r in rels]
    return any(not a or not b or a & b for a, b in combinations(types, 2))


def _only_counted(ctx: Context, clause: A.Match, then: A.Match | A.Projection | None) -> bool:
    """Whether a MATCH is one path of two physical relationships of whose middle node alone something is read, and what follows counts its rows."""
    if not isinstance(then, A.Projection) or then.star or ctx.needs is None or len(clause.paths) != 1:
        return False
    path = clause.paths[0]
    if path.var or len(path.rels) != 2 or not path.nodes[1].labels or not _may_meet(list(path.rels)):
        return False
    middle = path.nodes[1].var
    named = [x.var for x in (*path.nodes, *path.rels) if x.var]
    exprs = [*(i.expr for i in then.items), *(s.expr for s in then.order)]
    inner = [*exprs, *([clause.where] if clause.where is not None else [])]
    aggs = [x for e in exprs for x in A.walk(e) if isinstance(x, A.Agg)]
    if len(set(named)) < len(named) or any(v in named and v != middle for e in inner for v in A.variables(e)):
        return False
    # the other aggregates must not depend on how often a row stands
    if not any(A.has_aggregate(i.expr) for i in then.items) or any(a != A.Agg("count", None) and a.name not in ("min", "max") and not a.distinct for a in aggs):
        return False
    types = [t for r in path.rels for t in (r.types or ctx.catalog.edges)]
    labels = [x for n in path.nodes for x in (n.labels or ctx.catalog.labels)]
    return all(t in ctx.catalog.edges and t not in ctx.catalog.virtual_edges for t in types) and not any(x not in ctx.catalog.labels or ctx.catalog.labels[x].virtual or _lookup(ctx, x) for x in labels)


def _counted(ctx: Context, clause: A.Match) -> Scope | None:
    """The middle nodes of a path (a)-[x]-(n)-[y]-(b), each row with the number of binding rows that it stands for; None if its columns do not allow it.

    No pair of x and y becomes a row. A middle node with X and Y edges on its sides has X * Y pairs; of those with one type
    the ones that are not two different edges, or of which an edge has no id, are taken off.
    """
    path = clause.paths[0]
    first, middle, last = path.nodes
    name = middle.var or "@middle"
    one, ((_, x),) = _with_path(ctx, None, A.Path(None, (first, A.Node(name, middle.labels, middle.props)), path.rels[:1]), True)
    own, types = one.vars[name], one.types()
    group = [k for k in own.columns if k in types]
    nodes = typed(one.frame.select(*[c(k) for k in group]).distinct(), {k: types[k] for k in group})
    two, ((_, y),) = _with_path(ctx, Scope(nodes, {name: own}), A.Path(None, (A.Node(name), last), path.rels[1:]), True)
    kind = types[f"{x.prefix}@id"]
    if kind != two.types()[f"{y.prefix}@id"] or not all(isinstance(t, (T.IntegralType, T.StringType)) for t in (kind, *(types[k] for k in group))):
        return None
    key, zero = [c(k) for k in group], F.lit(0).cast("long")

    def edges(frame: DataFrame, e: Entity, is_x: bool) -> DataFrame:
        n = F.count(F.lit(1))
        return frame.groupBy(*key, e.meta("label").alias("@type"), e.meta("id").alias("@edge")).agg((n if is_x else zero).alias("@x"), (zero if is_x else n).alias("@y"))

    each = edges(one.frame, x, True).union(edges(two.frame, y, False)).groupBy(*key, "`@type`", "`@edge`").agg(F.sum("`@x`").alias("@x"), F.sum("`@y`").alias("@y"))
    known = c("@edge").isNotNull()

    def total(value, where=None):
        return F.sum(value if where is None else F.when(where, value).otherwise(zero))

    different = total(c("@x"), known) * total(c("@y"), known) - total(c("@x") * c("@y"), known)
    kinds = each.groupBy(*key, "`@type`").agg(total(c("@x")).alias("@x"), total(c("@y")).alias("@y"), different.alias("@different"))
    times = f"{ctx.prefix()}@times"
    pairs = total(c("@x")) * total(c("@y")) - total(c("@x") * c("@y")) + total(c("@different"))
    frame = typed(kinds.groupBy(*key).agg(pairs.alias(times)).where(c(times) > 0), {k: types[k] for k in group} | {times: T.LongType()})
    return Scope(frame, {name: own}, times=times)


def match(ctx: Context, scope: Scope | None, clause: A.Match, then: A.Match | A.Projection | None = None) -> Scope:
    """Binding rows of a MATCH: its paths joined on shared variables, no edge used twice, then its WHERE.

    ``then`` is the clause after it: where that only counts the rows, they may be given as numbers (``Scope.times``).
    """
    used: list[tuple[A.Rel, Entity]] = []
    ctx.where = clause.where
    if scope is None and _only_counted(ctx, clause, then):
        counted = _counted(ctx, clause)
        if counted:
            if clause.where is not None:
                counted.where(Compiler(counted, ctx.params).truth(clause.where))
            return counted
    shared = _may_meet([r for path in clause.paths for r in path.rels])
    for path in clause.paths:
        scope, rels = _with_path(ctx, scope, path, shared)
        used += rels
    for (_, a), (_, b) in combinations(used if shared else [], 2):
        if set(a.labels) & set(b.labels):
            types = scope.types()
            same = keys_equal(a.meta("id"), types[f"{a.prefix}@id"], b.meta("id"), types[f"{b.prefix}@id"])
            scope.where(~((a.meta("label") == b.meta("label")) & same))
    if clause.where is not None:
        scope.where(Compiler(scope, ctx.params).truth(clause.where))
    return scope
