"""The engine: query text to DataFrame, JSON or records."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from graphloom import errors
from graphloom.errors import GraphQueryError, SyntaxRejected
from graphloom.operators.frames import Context, union
from graphloom.operators.match import match
from graphloom.operators.project import project, shown
from graphloom.plans import ast as A
from graphloom.plans.parser import parse
from graphloom.plans.scope import check
from graphloom.plans.usage import needs_after
from graphloom.sources.catalog import GraphCatalog

# Rows of an answer without LIMIT, with and without other sources, and at most.
DEFAULT_ROWS, DEFAULT_ROWS_EXTERNAL, MOST_ROWS = 5000, 1000, 8000


@dataclass
class Answer:
    frame: DataFrame
    kinds: dict[str, str]
    limited: bool
    external: bool


class GraphEngine:
    """Answers queries over a catalog. ``strict_boundaries``: virtual edges only where the language contract allows them. ``timeout``: seconds after which ``execute`` and ``execute_records`` cancel a query's jobs."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog, strict_boundaries: bool = True, timeout: float | None = None):
        self.spark, self.catalog, self.strict, self.timeout = spark, catalog, strict_boundaries, timeout

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The answer as a lazy DataFrame without implicit limits: nodes and edges as structs, paths as arrays."""
        return self._answer(text, params).frame

    def execute(self, text: str, params: dict[str, Any] | None = None) -> str:
        """The answer as a JSON array, limited; if it has one column of paths, one row holds all of them."""
        answer = self._answer(text, params)
        rows = [self._json_row(r, answer.kinds) for r in self._collected(answer)]
        if rows and list(answer.kinds.values()) == ["path"]:
            name = next(iter(answer.kinds))
            rows = [{name: [r[name] for r in rows]}]
        return json.dumps(rows, ensure_ascii=False, default=str)

    def execute_records(self, text: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        """The answer as dictionaries, limited; nodes have _id, _labels and _properties, edges also _type, _startId and _endId."""
        answer = self._answer(text, params)
        return [{k: _record(v, answer.kinds[k]) for k, v in r.asDict(True).items()} for r in self._collected(answer)]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL as it is."""
        return self.spark.sql(text)

    def _json_row(self, row, kinds: dict[str, str]) -> dict[str, Any]:
        out = {}
        for k, v in row.asDict(True).items():
            if kinds[k] == "path" and v is not None:
                v = [{"type": s["type"], "label": s["label"], "props": json.loads(s["props"])} for s in v]
            elif kinds[k] == "node" and v is not None:
                v = {a: b for a, b in v.items() if b is not None}
            elif kinds[k] == "edge" and v is not None:
                v = {"type": v["type"], "startNodeId": v["startNodeId"], "endNodeId": v["endNodeId"], "properties": {a: b for a, b in (v.get("properties") or {}).items() if b is not None}}
            if v is not None:
                out[k] = v
        return out

    def _collected(self, answer: Answer) -> list:
        most = MOST_ROWS if answer.limited else DEFAULT_ROWS_EXTERNAL if answer.external else DEFAULT_ROWS
        try:
            with self._cancelled_in_time() as expired:
                return answer.frame.limit(most).collect()
        except PySparkException as e:
            if expired.is_set():
                raise GraphQueryError(f"The query took over {self.timeout} s", errors.EXECUTION) from e
            raise GraphQueryError(str(e).split("JVM stacktrace")[0][:2000], errors.EXTERNAL_SOURCE if "lookup failed" in str(e) else errors.EXECUTION) from e
        except Py4JJavaError as e:  # a job that was cancelled
            raise GraphQueryError(f"The query took over {self.timeout} s" if expired.is_set() else str(e)[:2000], errors.EXECUTION) from e

    @contextmanager
    def _cancelled_in_time(self) -> Iterator[threading.Event]:
        """Jobs of the block are cancelled when the timeout has passed; the event says whether it has."""
        expired, tag = threading.Event(), f"graphloom-{uuid.uuid4().hex}"
        if self.timeout is None:
            yield expired
            return

        def expire() -> None:
            expired.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        self.spark.sparkContext.addJobTag(tag)
        clock = threading.Timer(self.timeout, expire)
        clock.daemon = True
        clock.start()
        try:
            yield expired
        finally:
            clock.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def _answer(self, text: str, params: dict[str, Any] | None) -> Answer:
        query = parse(text)
        check(query, self.catalog, self.strict)
        ctx = Context(self.spark, self.catalog, params or {})
        if query.snapshot:
            ctx.snapshot = (query.snapshot.strategy, _moment(ctx, query.snapshot.at), query.snapshot.labels)
        try:
            frame, kinds = self._single(ctx, query.parts[0], query.project)
            for part, keep_all in zip(query.parts[1:], query.union_all, strict=True):
                other, more = self._single(ctx, part, query.project)
                if list(kinds) != list(more):
                    raise SyntaxRejected("All parts of a UNION must have the same columns")
                frame = union([frame, other])
                if not keep_all:
                    frame = frame.distinct()
                elif "path" in kinds.values() and set(kinds.values()) == {"path"}:
                    frame = frame.distinct()
                kinds = {k: v if more[k] == v else "value" for k, v in kinds.items()}
        except PySparkException as e:
            raise GraphQueryError(str(e).split("JVM stacktrace")[0][:2000], errors.EXECUTION) from e
        last = query.parts[-1].returns
        return Answer(frame, kinds, last is not None and last.limit is not None, ctx.external)

    def _single(self, ctx: Context, part: A.Single, by_label: dict[str, tuple[str, ...]]) -> tuple[DataFrame, dict[str, str]]:
        scope, needs = None, needs_after(part)
        following = [*part.clauses[1:], part.returns]
        for clause, then, ctx.needs in zip(part.clauses, following, needs, strict=False):
            scope = match(ctx, scope, clause, then) if isinstance(clause, A.Match) else project(ctx, scope, clause)[0]
        if part.returns is None:
            return shown(scope, list(scope.vars), by_label)
        ctx.needs = needs[-1]
        scope, names = project(ctx, scope, part.returns, final=True)
        return shown(scope, names, by_label)


def _moment(ctx: Context, e: A.Expr) -> int:
    from graphloom.functions.expressions import parameter

    value = e.value if isinstance(e, A.Lit) else parameter(ctx.params, e.name) if isinstance(e, A.Param) else None
    if not isinstance(value, int) or isinstance(value, bool):
        raise SyntaxRejected("Snapshot time must be a whole number")
    return value


def _record(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == "node":
        props = {k: v for k, v in value.items() if k not in ("id", "label") and v is not None}
        return {"_id": value.get("id"), "_labels": [value["label"]], "_properties": props}
    if kind == "edge":
        props = {k: v for k, v in (value.get("properties") or {}).items() if v is not None}
        return {"_id": value["id"], "_type": value["type"], "_startId": value["startNodeId"], "_endId": value["endNodeId"], "_properties": props}
    if kind == "path":
        steps = [{"type": s["type"], "label": s["label"], "props": json.loads(s["props"])} for s in value]
        return {"nodes": [s for s in steps if s["type"] == "node"], "relationships": [s for s in steps if s["type"] == "edge"], "length": len(steps) // 2}
    return value
