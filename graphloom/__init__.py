"""A read-only property-graph query engine on Spark DataFrames."""

from graphloom.engine import GraphEngine
from graphloom.errors import GraphQueryError, SyntaxRejected, VirtualEdgeRejected
from graphloom.sources.catalog import GraphCatalog
from graphloom.sources.lookup import LookupSource, Request

__all__ = ["GraphCatalog", "GraphEngine", "GraphQueryError", "LookupSource", "Request", "SyntaxRejected", "VirtualEdgeRejected"]
