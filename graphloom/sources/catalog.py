"""What labels and edge types of a graph stand for: DataFrames, foreign keys and declared joins with other sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphloom import errors
from graphloom.errors import GraphQueryError
from graphloom.sources.lookup import LookupSource

#: Name of the source of all labels and edges that aren't virtual.
GRAPH = "graph"
#: Frames with prefixed columns that a catalog remembers before it starts anew.
REMEMBERED = 1000
#: Key of a mapping that stands for the entity's id.
ID = "_id"


@dataclass(frozen=True)
class NodeLabel:
    """Nodes of one label. A virtual label comes from another source; ``time_column`` is what snapshots look at."""

    name: str
    rows: DataFrame | Callable[[], DataFrame] | LookupSource
    id_column: str
    source: str = GRAPH
    time_column: str | None = None
    entity_key: tuple[str, ...] = ()

    @property
    def virtual(self) -> bool:
        return self.source != GRAPH

    def frame(self) -> DataFrame:
        if isinstance(self.rows, LookupSource):
            raise GraphQueryError(f"Label {self.name} can only be looked up by key", errors.EXTERNAL_SOURCE)
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()


@dataclass(frozen=True)
class EdgeType:
    """Physical edges of one type between two labels: rows of a table, or a foreign key of one of the labels.

    Table: ``rows`` with columns ``start`` and ``end``, and ``id_column`` if a column tells edges apart.
    Foreign key: ``rows`` is None; ``owner`` is 'start' or 'end', and ``key`` its column with the other's id.
    """

    name: str
    start_label: str
    end_label: str
    rows: DataFrame | Callable[[], DataFrame] | None = None
    start: str = ""
    end: str = ""
    id_column: str | None = None
    owner: str = ""
    key: str = ""

    def frame(self) -> DataFrame:
        return self.rows if isinstance(self.rows, DataFrame) else self.rows()


@dataclass(frozen=True)
class VirtualEdge:
    """A declared equality join between a physical label and a virtual one: ``mapping`` pairs physical with virtual columns, all of which must agree.

    The edge leads from the physical to the virtual side, and from the virtual to the physical one if ``first_hop_only``.
    """

    name: str
    target_label: str
    mapping: tuple[tuple[str, str], ...]
    physical_label: str | None = None
    first_hop_only: bool = False
    last_hop_only: bool = False
    operator: str = ""
    output_fields: tuple[str, ...] = ()


@dataclass
class GraphCatalog:
    """Labels, edge types and virtual edges by name; nothing expires."""

    labels: dict[str, NodeLabel] = field(default_factory=dict)
    edges: dict[str, list[EdgeType]] = field(default_factory=dict)
    virtual_edges: dict[str, VirtualEdge] = field(default_factory=dict)
    sources: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    frames: dict[Any, Any] = field(default_factory=dict, repr=False)

    def remembered(self, rows: DataFrame, key: Any, make: Callable[[], Any]) -> Any:
        """What ``make`` gave for the key before, if it was for the same DataFrame."""
        found = self.frames.get(key)
        if found is None or found[0] is not rows:
            if len(self.frames) >= REMEMBERED:
                self.frames.clear()
            found = self.frames[key] = (rows, make())
        return found[1]

    def register_source(self, name: str, load: Callable[[], DataFrame]) -> None:
        """A named reader; names are found whatever their case."""
        self.sources[name.lower()] = load

    def source(self, name: str) -> Callable[[], DataFrame]:
        try:
            return self.sources[name.lower()]
        except KeyError:
            raise GraphQueryError(f"Unknown data source: {name}", errors.METADATA_NOT_FOUND) from None

    def healthy(self, name: str) -> bool:
        """Whether the source gives its first row without an error."""
        try:
            self.source(name)().limit(1).collect()
        except Exception:
            return False
        return True

    def node(self, name: str, rows, id_column: str, *, source: str = GRAPH, time_column: str | None = None, entity_key: tuple[str, ...] | str = ()) -> GraphCatalog:
        """Registers a label. ``rows``: a DataFrame, a function that gives one, the name of a registered source, or a LookupSource."""
        if isinstance(rows, str):
            rows = self.source(rows)
        key = (entity_key,) if isinstance(entity_key, str) else tuple(entity_key)
        self.labels[name] = NodeLabel(name, rows, id_column, source, time_column, key)
        return self

    def edge(self, name: str, start_label: str, end_label: str, rows, start: str, end: str, id_column: str | None = None) -> GraphCatalog:
        self.edges.setdefault(name, []).append(EdgeType(name, start_label, end_label, rows, start, end, id_column))
        return self

    def foreign_key(self, name: str, start_label: str, end_label: str, owner: str, key: str) -> GraphCatalog:
        if owner not in ("start", "end"):
            raise GraphQueryError("owner must be 'start' or 'end'", errors.METADATA_INVALID)
        self.edges.setdefault(name, []).append(EdgeType(name, start_label, end_label, owner=owner, key=key))
        return self

    def virtual_edge(self, name: str, target_label: str, mapping: dict[str, str], **more) -> GraphCatalog:
        if not mapping:
            raise GraphQueryError(f"Virtual edge {name} has no key mapping", errors.METADATA_INVALID)
        self.virtual_edges[name] = VirtualEdge(name, target_label, tuple(mapping.items()), **more)
        return self

    def label(self, name: str) -> NodeLabel:
        try:
            return self.labels[name]
        except KeyError:
            raise GraphQueryError(f"Unknown label: {name}", errors.METADATA_NOT_FOUND) from None

    def key_columns(self, labels: tuple[str, ...]) -> set[str]:
        """Columns of the labels by which edges join."""
        out = {e.key for own in self.edges.values() for e in own if e.rows is None and (e.start_label if e.owner == "start" else e.end_label) in labels}
        for e in self.virtual_edges.values():
            out |= {a for a, _ in e.mapping if e.physical_label is None or e.physical_label in labels} | {b for _, b in e.mapping if e.target_label in labels}
        return out

    def is_virtual(self, label: str) -> bool:
        return label in self.labels and self.labels[label].virtual

    def check_edge(self, name: str) -> None:
        if name not in self.edges and name not in self.virtual_edges:
            raise GraphQueryError(f"Unknown edge type: {name}", errors.METADATA_NOT_FOUND)


def parquet(spark: SparkSession, path: str) -> Callable[[], DataFrame]:
    """A reader of Parquet files, for register_source and node."""
    return lambda: spark.read.parquet(path)
