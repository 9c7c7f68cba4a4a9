"""Pairs of relationships that are only counted: as many as the pairs that stand as rows, and no time for each."""

import pytest
from pyspark.sql import functions as F

from graphloom import GraphCatalog, GraphEngine
from graphloom.operators import match

PEOPLE = [(1, "a", 10), (2, "b", 10), (3, "c", 20), (4, "d", None), (5, "e", 10), (5, "e2", 20), (None, "f", 10), (None, "g", 20), (6, "h", 99)]
TOWNS = [(10, "X"), (20, "Y"), (20, "Y"), (30, "Z"), (10, "X2"), (None, "N")]
SHOPS = [(1, 10), (2, 20), (3, 20)]
KNOWS = [(100, 1, 2), (101, 2, 1), (102, 1, 1), (103, 1, 3), (103, 3, 1), (None, 2, 3), (104, 5, 1)]
QUERIES = [
    "MATCH (a:Person)-[:LIVES]->(t:Town)<-[:LIVES]-(b:Person) RETURN t.name AS t, count(*) AS n",
    "MATCH (:Person)-[:LIVES]->(t:Town)<-[:LIVES|STANDS]-() RETURN t, count(*) AS n",
    "MATCH (:Person)-[:LIVES|STANDS]->(t:Town)<-[:STANDS|LIVES]-() WHERE t.name <> 'X2' RETURN count(*) AS n, min(t.name) AS lo, count(DISTINCT t.name) AS names",
    "MATCH (a:Person)-[:LIVES]->(t:Town {name: 'none'})<-[:LIVES]-(b:Person) RETURN count(*) AS n",
    "MATCH (a:Person)-[:KNOWS]->(b:Person)-[:KNOWS]->(c:Person) RETURN b.name AS b, count(*) AS n ORDER BY n DESC, b LIMIT 3",
    "MATCH (a:Person)-[:KNOWS]-(b:Person)-[:KNOWS]-(c) WITH b, count(*) AS n WHERE n > 1 MATCH (b)-[:LIVES]->(t:Town) RETURN b.name AS b, t.name AS t, n AS n",
    "MATCH (a:Person {name: 'a'})-[]-(b:Person)-[]-(c) RETURN b.name AS b, count(*) AS n",
    # pairs that must stand as rows
    "MATCH (a:Person)-[:LIVES]->(t:Town)<-[:LIVES]-(b:Person) WHERE a.name < b.name RETURN t.name AS t, count(*) AS n",
    "MATCH (a:Person)-[:LIVES]->(t:Town)<-[:LIVES]-(b:Person) RETURN t.name AS t, count(*) AS n, sum(t.tid) AS s",
]


@pytest.fixture(scope="module")
def towns(spark):
    out = GraphCatalog()
    out.node("Person", spark.createDataFrame(PEOPLE, "pid long, name string, town long"), "pid")
    out.node("Town", spark.createDataFrame(TOWNS, "tid long, name string"), "tid")
    out.node("Shop", spark.createDataFrame(SHOPS, "sid long, town long"), "sid")
    out.foreign_key("LIVES", "Person", "Town", "start", "town")
    out.foreign_key("STANDS", "Shop", "Town", "start", "town")
    out.edge("KNOWS", "Person", "Person", spark.createDataFrame(KNOWS, "kid long, a long, b long"), "a", "b", id_column="kid")
    return out


@pytest.mark.parametrize("query", QUERIES)
def test_as_many_as_the_rows(spark, towns, query, monkeypatch):
    def answer():
        return sorted(map(str, GraphEngine(spark, towns).query(query).collect()))

    got = answer()
    monkeypatch.setattr(match, "_only_counted", lambda *_: False)
    assert got == answer()


def test_many_pairs_take_no_time_each(spark):
    """20 billion pairs within a minute."""
    catalog = GraphCatalog()
    catalog.node("Person", spark.range(200_000).select(F.col("id").alias("pid"), (F.col("id") % 2).alias("town")), "pid")
    catalog.node("Town", spark.range(2).toDF("tid"), "tid")
    catalog.foreign_key("LIVES", "Person", "Town", "start", "town")
    got = GraphEngine(spark, catalog, timeout=60).execute_records("MATCH (a:Person)-[:LIVES]->(t:Town)<-[:LIVES]-(b:Person) RETURN t.tid AS t, count(*) AS n ORDER BY t")
    assert got == [{"t": t, "n": 100_000 * 99_999} for t in (0, 1)]
