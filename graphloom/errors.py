"""Errors with stable codes."""

from __future__ import annotations

# Codes that callers rely on.
PARSE, REWRITE, EXECUTION = 1001, 1002, 1003
VIRTUAL_EDGE, PATH = 2001, 2002
SOURCE_CONNECTION, SOURCE_QUERY, EXTERNAL_SOURCE = 3001, 3002, 3003
METADATA_NOT_FOUND, METADATA_INVALID = 4001, 4002
BATCH, UNION = 5002, 5003
CONFIGURATION, SERIALIZATION, UNKNOWN = 6001, 6002, 9999


class GraphQueryError(Exception):
    """A query that cannot be answered; ``code`` says why."""

    def __init__(self, message: str, code: int = UNKNOWN):
        super().__init__(message)
        self.code = code


class SyntaxRejected(GraphQueryError):
    def __init__(self, message: str):
        super().__init__(message, PARSE)


class VirtualEdgeRejected(GraphQueryError):
    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(dict.fromkeys(reasons)), VIRTUAL_EDGE)
