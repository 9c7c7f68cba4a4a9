"""Lookup sources: what a call is told, how many calls there are, where a pattern starts."""

import json
import time

import pytest

from graphloom import GraphCatalog, GraphEngine, GraphQueryError, LookupSource


def shelves(log, broken=0, slow=0.0):
    """Books by shelf, from a service that writes down what it is asked."""

    def fetch(request):
        if slow:
            time.sleep(slow)
        with open(log, "a") as f:
            f.write(json.dumps([request.key, request.keys, request.filters, request.columns, request.operator, request.snapshot]) + "\n")
        with open(log) as f:
            if len(f.readlines()) <= broken:
                raise OSError("no answer")
        wanted = range(100) if request.keys is None else request.keys
        rows = [{"book": f"b{s}-{i}", "shelf": s, "genre": "xyz"[(s + i) % 3], "pages": 10 * s + i, "note": "long"} for s in wanted for i in range(2)]
        return [r for r in rows if all(r[c] == v for c, op, v in request.filters if op == "=")]

    return fetch


@pytest.fixture
def library(spark, tmp_path):
    def make(**more):
        log = str(tmp_path / "calls")
        shop = {k: more.pop(k) for k in ("broken", "slow") if k in more}
        source = LookupSource(shelves(log, **shop), "book string, shelf long, genre string, pages long, note string", "shelf", **more)
        out = GraphCatalog()
        out.node("Room", spark.createDataFrame([(r, f"room {r}") for r in range(4)], "room long, name string"), "room")
        out.node("Shelf", spark.range(100).selectExpr("id AS shelf", "id % 4 AS room"), "shelf")
        out.foreign_key("IN", "Shelf", "Room", "start", "room")
        out.node("Book", source, "book", source="catalogue")
        out.virtual_edge("HOLDS", "Book", {"shelf": "shelf"}, physical_label="Shelf", last_hop_only=True, operator="booksOnShelves", output_fields=("book", "genre"))
        out.virtual_edge("STANDS_ON", "Book", {"shelf": "shelf"}, physical_label="Shelf", first_hop_only=True)
        return GraphEngine(spark, out), GraphEngine(spark, out, strict_boundaries=False), lambda: [json.loads(x) for x in open(log)]

    return make


def test_a_hundred_keys_are_one_call(library):
    engine, _, calls = library()
    rows = engine.query("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b.book AS b").collect()
    assert len(rows) == 200 and len(calls()) == 1
    key, keys, filters, columns, operator, _ = calls()[0]
    assert key == "shelf" and sorted(keys) == list(range(100)) and filters == [] and operator == "booksOnShelves"
    assert columns == ["book", "shelf"]


def test_batches_hold_as_many_keys_as_they_may(library):
    engine, _, calls = library(batch=30)
    assert engine.query("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b.book AS b").count() == 200
    assert sorted(len(c[1]) for c in calls()) == [10, 30, 30, 30]


def test_a_call_is_told_conditions_and_columns(library):
    engine, _, calls = library()
    text = "MATCH (r:Room {name: 'room 1'})<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book {genre: $g}) WHERE 100 < b.pages AND b.book STARTS WITH 'b' AND (b.pages < 900 OR s.shelf = 97) RETURN s.shelf AS s, count(b) AS n"
    got = {r.s: r.n for r in engine.query(text, {"g": "x"}).collect()}
    want = {}
    for s in range(1, 100, 4):
        for i in range(2):
            if (s + i) % 3 == 0 and 10 * s + i > 100 and (10 * s + i < 900 or s == 97):
                want[s] = want.get(s, 0) + 1
    assert got == want
    (call,) = calls()
    assert sorted(call[1]) == list(range(1, 100, 4))
    assert call[2] == [["genre", "=", "x"], ["pages", ">", 100], ["book", "STARTS WITH", "b"]] and call[3] == ["book", "shelf", "genre", "pages"]


def test_a_node_that_is_returned_whole_has_the_output_fields(library):
    engine, relaxed, calls = library()
    found = engine.execute_records("MATCH (r:Room)<-[:IN]-(s:Shelf {shelf: 3})-[:HOLDS]->(b:Book) RETURN b")
    assert sorted(x["b"]["_id"] for x in found) == ["b3-0", "b3-1"] and set(found[0]["b"]["_properties"]) == {"book", "shelf", "genre"}
    assert calls()[0][3] == ["book", "shelf", "genre"]


def test_a_searchable_source_starts_a_pattern(library):
    engine, relaxed, calls = library(searchable=True)
    rows = engine.query("MATCH (b:Book {book: 'b7-1'})-[:STANDS_ON]->(s:Shelf)-[:IN]->(r:Room) RETURN r.name AS r, b.genre AS g").collect()
    assert [tuple(r) for r in rows] == [("room 3", "z")]
    assert [c[1:4] for c in calls()] == [[None, [["book", "=", "b7-1"]], ["book", "shelf", "genre"]]]
    assert relaxed.query("MATCH (b:Book) WHERE b.genre = 'y' RETURN b.book AS b").count() == sum((s + i) % 3 == 1 for s in range(100) for i in range(2))
    assert relaxed.query("MATCH (b:Book) RETURN count(*) AS n").first().n == 200


def test_a_source_that_needs_keys_starts_none(library):
    _, relaxed, calls = library()
    with pytest.raises(GraphQueryError, match="can be scanned") as e:
        relaxed.query("MATCH (b:Book {book: 'b7-1'}) RETURN b")
    assert e.value.code == 3003


def test_failed_calls_are_repeated(library):
    engine, _, calls = library(broken=2)
    assert len(engine.execute_records("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b.book AS b")) == 200 and len(calls()) == 3
    engine, _, calls = library(broken=99, retries=1)
    with pytest.raises(GraphQueryError, match="lookup failed after 2 calls") as e:
        engine.execute("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b")
    assert e.value.code == 3003


def test_slow_calls_and_slow_queries_end(library, spark):
    engine, _, _ = library(slow=5.0, timeout=0.2, retries=0)
    with pytest.raises(GraphQueryError, match="no answer within 0.2 s"):
        engine.execute("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b")
    engine, _, _ = library(slow=30.0)
    hasty = GraphEngine(spark, engine.catalog, timeout=1.0)
    began = time.monotonic()
    with pytest.raises(GraphQueryError, match="took over 1.0 s") as e:
        hasty.execute("MATCH (r:Room)<-[:IN]-(s:Shelf)-[:HOLDS]->(b:Book) RETURN b")
    assert e.value.code == 1003 and time.monotonic() - began < 20
