"""Sources that are asked for rows by key or by conditions, such as a REST service."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Request:
    """One call to a source.

    ``keys`` are values of the column ``key``, or None if all rows that meet the conditions are wanted. ``filters`` are
    (column, operator, value), all of which must hold; a source may leave them to the engine, which applies them again.
    ``columns`` are the ones that are read, ``operator`` is what the virtual edge calls its query, ``snapshot`` a
    strategy with its time.
    """

    key: str
    keys: tuple | None = None
    filters: tuple[tuple[str, str, Any], ...] = ()
    columns: tuple[str, ...] = ()
    operator: str = ""
    snapshot: tuple[str, int] | None = None


@dataclass(frozen=True)
class LookupSource:
    """``fetch(request)`` gives dictionaries of the rows that a Request asks for; ``schema`` is their DDL.

    A query asks for its distinct keys only, ``batch`` of them a call and ``parallel`` calls of a task at a time. Keys
    are gathered into few tasks, so that up to ``batch`` keys are one call (as far as Spark's adaptive execution, which
    does the gathering, is on). With ``searchable`` the source also answers without keys, so that a pattern can start
    from it. A call that raises or outlasts ``timeout`` seconds is repeated up to ``retries`` times, after 0.1, 0.2, ...
    seconds; then the query fails as a whole. ``fetch`` runs on the executors and must be free of effects, as a lost
    task runs again.
    """

    fetch: Callable[[Request], list[dict]]
    schema: str
    key: str
    batch: int = 1000
    retries: int = 3
    timeout: float = 30.0
    searchable: bool = False
    parallel: int = 4

    def fields(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)

    def rows(self, keys: DataFrame, request: Request) -> DataFrame:
        """The rows for a DataFrame of one key column."""
        wanted = keys.where(F.col(keys.columns[0]).isNotNull()).distinct().hint("rebalance")
        ask, schema = self._asker(request)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = (v for b in batches for v in b.column(0).to_pylist())
            chunks = iter(lambda: tuple(islice(values, self.batch)), ())
            with ThreadPoolExecutor(self.parallel) as pool:
                while some := list(islice(chunks, self.parallel)):
                    yield from pool.map(ask, some)

        return wanted.mapInArrow(run, schema)

    def search(self, spark: SparkSession, request: Request) -> DataFrame:
        """The rows that meet the request's conditions, by a single call."""
        ask, schema = self._asker(request)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield ask(None)

        return spark.range(1).coalesce(1).mapInArrow(run, schema)

    def _asker(self, request: Request):
        """A function that asks for some keys, and the schema of what it gives."""
        fields = self.fields()
        schema = T.StructType([f for f in fields.fields if not request.columns or f.name in request.columns])
        request = replace(request, columns=tuple(schema.fieldNames()))
        arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])
        fetch, retries, timeout = self.fetch, self.retries, self.timeout

        def ask(keys: tuple | None) -> pa.RecordBatch:
            for attempt in range(retries + 1):
                try:
                    found = within(lambda: fetch(replace(request, keys=keys)), timeout)
                    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in found], schema=arrow)
                except Exception as e:
                    if attempt == retries:
                        raise RuntimeError(f"lookup failed after {attempt + 1} calls: {e!r}") from e
                    time.sleep(0.1 * (attempt + 1))
            raise AssertionError

        return ask, schema


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def within(call: Callable[[], Any], seconds: float) -> Any:
    """What ``call`` gives, or TimeoutError; its thread does not keep the process alive."""
    out: list = []

    def run() -> None:
        try:
            out.append((call(), None))
        except Exception as e:
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer within {seconds} s")
    value, error = out[0]
    if error is not None:
        raise error
    return value
