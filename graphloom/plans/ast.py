"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    """Base of all expressions; they compare by structure."""


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class HasLabels(Expr):
    of: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Agg(Expr):
    name: str
    arg: Expr | None
    distinct: bool = False


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logic(Expr):
    op: str  # AND, OR
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    among: Expr


@dataclass(frozen=True)
class TextMatch(Expr):
    op: str  # STARTS WITH, ENDS WITH, CONTAINS
    of: Expr
    what: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool = False


@dataclass(frozen=True)
class Node:
    var: str | None
    labels: tuple[str, ...] = ()
    props: MapOf | Param | None = None


@dataclass(frozen=True)
class Rel:
    var: str | None
    types: tuple[str, ...] = ()
    props: MapOf | Param | None = None
    direction: str = "both"  # out, in, both


@dataclass(frozen=True)
class Path:
    var: str | None
    nodes: tuple[Node, ...]
    rels: tuple[Rel, ...] = ()


@dataclass(frozen=True)
class Match:
    paths: tuple[Path, ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Sort:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Projection:
    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple[Sort, ...] = ()
    limit: Expr | None = None
    where: Expr | None = None


@dataclass(frozen=True)
class Single:
    clauses: tuple[Match | Projection, ...]  # WITH is a Projection
    returns: Projection | None = None


@dataclass(frozen=True)
class Snapshot:
    strategy: str
    at: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Query:
    parts: tuple[Single, ...]
    union_all: tuple[bool, ...] = ()
    snapshot: Snapshot | None = None
    project: dict[str, tuple[str, ...]] = field(default_factory=dict)


def children(e: Any) -> list[Expr]:
    """The expressions directly inside one."""
    match e:
        case Prop(of, _) | HasLabels(of, _) | Not(of) | IsNull(of, _):
            return [of]
        case ListOf(items) | Logic(_, items):
            return list(items)
        case MapOf(items):
            return [v for _, v in items]
        case Agg(_, arg, _):
            return [arg] if arg is not None else []
        case Compare(_, a, b) | In(a, b) | TextMatch(_, a, b):
            return [a, b]
    return []


def walk(e: Expr):
    yield e
    for c in children(e):
        yield from walk(c)


def has_aggregate(e: Expr) -> bool:
    return any(isinstance(x, Agg) for x in walk(e))


def variables(e: Expr) -> list[str]:
    return [x.name for x in walk(e) if isinstance(x, Var)]
