"""Answers over a small power grid: plants and their turbines in the graph; faults, plant readings and turbine readings from other sources."""

import json

import pytest

from graphloom import GraphCatalog, GraphEngine, GraphQueryError

HOUR = 3_600_000
NOON = 1_700_000_000_000

PLANTS = [("p1", "north", "Nordkraft"), ("p2", "south", "Sudwerk")]
TURBINES = [("t1", "T-1", "p1"), ("t2", "T-2", "p1"), ("t3", "T-3", "p2"), ("t4", "T-4", "p2")]
#: (id, region code, title, raised): two in the north, one in the south
FAULTS = [("f1", "north", "vibration", NOON), ("f2", "north", "overheat", NOON + HOUR), ("f3", "south", "vibration", NOON)]
OUTPUT = [("o1", "output", "p1", NOON + 100), ("o2", "output", "p2", NOON + 7 * HOUR)]
SPEED = [(f"s{i}", f"speed-{i}", f"t{i}", NOON + h * HOUR) for i, h in ((1, 1), (2, 2), (3, -1), (4, 8))]


@pytest.fixture(scope="module")
def grid(spark):
    def table(rows, columns):
        return spark.createDataFrame(rows, columns)

    out = GraphCatalog()
    out.node("Plant", table(PLANTS, "pid string, region string, title string"), "pid")
    out.node("Turbine", table(TURBINES, "tid string, title string, plant string"), "tid")
    out.node("Fault", table(FAULTS, "fid string, code string, what string, raised long"), "fid", source="faults", time_column="raised")
    for label, rows in (("Output", OUTPUT), ("Speed", SPEED)):
        out.node(label, table(rows, "rid string, title string, of string, at long"), "rid", source="meters", time_column="at")
    out.edge("RUNS", "Plant", "Turbine", table([(p, t) for t, _, p in TURBINES], "a string, b string"), "a", "b")
    out.virtual_edge("GIVES", "Output", {"pid": "of"}, physical_label="Plant", last_hop_only=True)
    out.virtual_edge("SUFFERS", "Fault", {"region": "code"}, physical_label="Plant", last_hop_only=True)
    out.virtual_edge("SPINS", "Speed", {"_id": "of"}, physical_label="Turbine", last_hop_only=True)
    out.virtual_edge("SPEED_OF", "Speed", {"tid": "of"}, physical_label="Turbine", first_hop_only=True)
    return out


@pytest.fixture
def ask(spark, grid):
    def run(text, params=None, relaxed=False):
        return GraphEngine(spark, grid, strict_boundaries=not relaxed).execute_records(text, params)

    return run


def names(rows, key):
    return sorted(r[key]["_properties"].get("title") or r[key]["_properties"]["what"] for r in rows)


class TestSeveralKindsOfTargets:
    pattern = "MATCH (p:Plant {title: 'Nordkraft'})-[:RUNS|SUFFERS|GIVES]->(x)"

    def test_all_of_them_come_with_their_label(self, ask):
        rows = ask(f"{self.pattern} RETURN p, x", relaxed=True)
        assert names(rows, "x") == ["T-1", "T-2", "output", "overheat", "vibration"]
        assert {r["p"]["_id"] for r in rows} == {"p1"} and {r["x"]["_labels"][0] for r in rows} == {"Turbine", "Fault", "Output"}

    @pytest.mark.parametrize(("hours", "left"), [(-1, ["T-1", "T-2"]), (0.5, ["T-1", "T-2", "output", "vibration"]), (2, ["T-1", "T-2", "output", "overheat", "vibration"])])
    def test_a_snapshot_hides_what_came_later(self, ask, hours, left):
        rows = ask(f"USING SNAPSHOT('latest', $t) ON [Fault, Output] {self.pattern} RETURN x", {"t": int(NOON + hours * HOUR)}, relaxed=True)
        assert names(rows, "x") == left

    def test_project_by_shows_listed_fields_and_the_label(self, spark, grid):
        engine = GraphEngine(spark, grid, strict_boundaries=False)
        shown = [r["x"] for r in json.loads(engine.execute(f"{self.pattern} RETURN x PROJECT BY {{Fault: [what], Output: [title]}}"))]
        assert {"label": "Fault", "what": "overheat"} in shown and {"label": "Output", "title": "output"} in shown
        assert all(set(s) == {"id", "label", "tid", "title", "plant"} for s in shown if s["label"] == "Turbine")

    def test_conditions_on_some_labels_only(self, ask):
        assert names(ask(f"{self.pattern} WHERE x:Fault OR x.tid = 't2' RETURN x", relaxed=True), "x") == ["T-2", "overheat", "vibration"]


class TestPaths:
    def test_paths_of_both_branches_share_one_row(self, spark, grid):
        engine = GraphEngine(spark, grid, strict_boundaries=False)
        deep = "MATCH w = (p:Plant {title: 'Sudwerk'})-[:RUNS]->(t:Turbine)-[:SPINS]->(s:Speed) RETURN w"
        flat = "MATCH w = (p:Plant {title: 'Sudwerk'})-[:RUNS|GIVES]->(x) RETURN w"
        (row,) = json.loads(engine.execute(f"{deep} UNION {flat}"))
        assert sorted(len(w) for w in row["w"]) == [3, 3, 3, 5, 5]
        for walk in row["w"]:
            assert [s["type"] for s in walk] == ["node", "edge"] * (len(walk) // 2) + ["node"]
        twice = json.loads(engine.execute(f"{flat} UNION ALL {flat}"))
        assert len(twice[0]["w"]) == 3

    def test_a_path_keeps_its_rows_apart(self, ask):
        rows = ask("MATCH w = (p:Plant)-[:RUNS]->(t:Turbine)-[:SPINS]->(s:Speed) RETURN w, t.tid AS t, s.of AS of")
        assert len(rows) == 4 and all(r["t"] == r["of"] and r["w"]["length"] == 2 for r in rows)


def test_last_and_first_hops(ask):
    assert len(ask("MATCH (p:Plant)-[:RUNS]->(t:Turbine)-[:SPINS]->(s:Speed) RETURN p, t, s")) == 4
    assert ask("MATCH (s:Speed)-[:SPEED_OF]->(t:Turbine)<-[:RUNS]-(p:Plant) WHERE s.title = 'speed-3' RETURN p.title AS p, t.title AS t") == [{"p": "Sudwerk", "t": "T-3"}]


REFUSED = {
    "no label": ("MATCH (x) RETURN x", 1001, "start node must declare a label"),
    "virtual alone": ("MATCH (o:Output) RETURN o", 1001, "Pure virtual node patterns"),
    "virtual hop alone": ("MATCH (p:Plant)-[:GIVES]->(o:Output) RETURN o", 2001, "Single-hop virtual edges"),
    "goes on after a last hop": ("MATCH (p:Plant)-[:GIVES]->(o:Output)-[:RUNS]->(t:Turbine) RETURN o", 2001, "last hop"),
    "first hop comes second": ("MATCH (p:Plant)-[:RUNS]->(t:Turbine)-[:SPEED_OF]->(s:Speed) RETURN s", 2001, "first hop"),
    "between physical ones": ("MATCH (t:Turbine)<-[:RUNS]-(p:Plant)-[:GIVES]->(o:Output)-[:RUNS]->(u:Turbine) RETURN o", 2001, "sandwich"),
    "virtual to virtual": ("MATCH (s:Speed)-[:SPEED_OF]->(t:Turbine)-[:SPINS]->(u:Speed) RETURN u", 2001, "Virtual-to-virtual"),
    "two sources counted": ("MATCH (p:Plant)-[:RUNS]->(t:Turbine)-[:SPINS]->(s:Speed) RETURN count(p), count(s)", 1001, "single data source"),
    "unknown label": ("MATCH (x:Dam) RETURN x", 4001, "Unknown label"),
    "unknown edge": ("MATCH (t:Turbine)-[:FEEDS]->(x) RETURN t", 4001, "Unknown edge type"),
    "union of other columns": ("MATCH (t:Turbine) RETURN t.title AS a UNION MATCH (t:Turbine) RETURN t.title AS b", 1001, "same columns"),
    "no such parameter": ("MATCH (t:Turbine) WHERE t.title = $which RETURN t", 1003, "Missing parameter"),
    "undefined": ("MATCH (t:Turbine) RETURN u", 1001, "not defined"),
    "limit of text": ("MATCH (t:Turbine) RETURN t LIMIT 'x'", 1001, "LIMIT"),
    "sort beside distinct": ("MATCH (t:Turbine) RETURN DISTINCT t.plant AS p ORDER BY t.title", 1001, "ORDER BY after DISTINCT"),
}


@pytest.mark.parametrize("case", REFUSED)
def test_refusals(spark, grid, case):
    text, code, message = REFUSED[case]
    with pytest.raises(GraphQueryError, match=message) as e:
        GraphEngine(spark, grid).execute(text)
    assert e.value.code == code


def test_distinct_with_sort_keys_that_are_returned(ask):
    assert [r["p"] for r in ask("MATCH (t:Turbine) RETURN DISTINCT t.plant AS p ORDER BY t.plant DESC")] == ["p2", "p1"]
    rows = ask("MATCH (p:Plant)-[:RUNS]->(t:Turbine) RETURN DISTINCT p ORDER BY p.title DESC LIMIT 1")
    assert [r["p"]["_id"] for r in rows] == ["p2"]


def test_three_valued_logic_and_shapes(spark):
    engine = GraphEngine(spark, GraphCatalog().node("N", spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c", 2.0)], "id long, name string, x double"), "id"))

    def ids(where):
        return [r.id for r in engine.query(f"MATCH (n:N) WHERE {where} RETURN n.id AS id ORDER BY id").collect()]

    assert ids("NOT n.name = 'a'") == [3] and ids("n.name IS NULL") == [2] and ids("n.id IN [3, 'x', 1]") == [1, 3]
    assert [r.x for r in engine.query("MATCH (n:N) RETURN n.x AS x ORDER BY x DESC").collect()] == [None, 2.0, 1.5]
    assert json.loads(engine.execute("MATCH (n:N) WHERE n.id < 3 RETURN n ORDER BY n"))[1] == {"n": {"id": 2, "label": "N"}}
    assert engine.execute_records("MATCH (n:N {name: 'a'}) RETURN n")[0]["n"] == {"_id": 1, "_labels": ["N"], "_properties": {"name": "a", "x": 1.5}}


def test_row_limits(spark):
    engine = GraphEngine(spark, GraphCatalog().node("N", spark.range(9001), "id"))
    assert [len(engine.execute_records(f"MATCH (n:N) RETURN n.id{x}")) for x in ("", " LIMIT 9000", " LIMIT 7")] == [5000, 8000, 7]
    assert engine.query("MATCH (n:N) RETURN n.id").count() == 9001


def test_edges_without_an_id_column_are_their_rows(spark):
    """Equal rows are one edge; rows that differ anywhere, if only in one column, are two."""
    rows = [(1, 9, "x", 1.0), (2, 9, "x", 1.0), (3, 9, "y", None), (3, 9, "y", 2.0), (4, 9, "z", 0.0), (4, 9, "z", 0.0)]
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long")
    cat = GraphCatalog().node("N", nodes, "id").edge("E", "N", "N", spark.createDataFrame(rows, "a long, b long, kind string, w double"), "a", "b")
    engine = GraphEngine(spark, cat)
    pairs = [(i, j) for i, r in enumerate(rows) for j, s in enumerate(rows) if r != s]
    assert engine.query("MATCH (a:N)-[:E]->(b:N)<-[:E]-(c:N) RETURN a.id AS a, c.id AS c").count() == len(pairs)
    shown = engine.execute_records("MATCH (a:N)-[e:E]->(b:N) RETURN e")
    assert len({r["e"]["_id"] for r in shown}) == 5 and all(isinstance(r["e"]["_id"], int) for r in shown)
    assert engine.query("MATCH (a:N)-[e:E]->(b:N) RETURN count(DISTINCT e) AS n").first().n == 5


def test_a_group_key_that_is_read_later(spark):
    rows = spark.createDataFrame([(i, i % 3, f"n{i % 3}") for i in range(12)], "id long, k long, unread string")
    to = spark.createDataFrame([(i, f"name {i}", "unread") for i in range(3)], "id long, name string, other string")
    engine = GraphEngine(spark, GraphCatalog().node("A", rows, "id").node("B", to, "id").foreign_key("E", "A", "B", "start", "k"))
    frame = engine.query("MATCH (a:A)-[:E]->(b:B) WITH b, count(*) AS n MATCH (c:A)-[:E]->(b) WHERE c.id < 3 RETURN b.name AS name, n AS n, c.id AS c ORDER BY c")
    assert [tuple(r) for r in frame.collect()] == [(f"name {i}", 4, i) for i in range(3)]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "HashAggregate" in line]
    assert grouped and not any("other" in line or "unread" in line for line in grouped) and "SortAggregate" not in plan


def test_composite_keys_must_all_agree(spark):
    a = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "id long, p int, q int")
    b = spark.createDataFrame([("x", "1", 2), ("y", "1", 9)], "id string, p string, q int")
    cat = GraphCatalog().node("A", a, "id").node("B", b, "id", source="other").virtual_edge("AB", "B", {"p": "p", "q": "q"})
    rows = GraphEngine(spark, cat, strict_boundaries=False).query("MATCH (a:A)-[:AB]->(b:B) RETURN a.id AS a, b.id AS b").collect()
    assert [tuple(r) for r in rows] == [(1, "x")]


def test_physical_and_virtual_give_the_same(spark):
    a, b = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, k long"), spark.createDataFrame([(i, f"n{i}") for i in range(3)], "id long, name string")
    one = GraphCatalog().node("A", a, "id").node("B", b, "id").foreign_key("E", "A", "B", "start", "k")
    two = GraphCatalog().node("A", a, "id").node("B", b, "id", source="other").virtual_edge("E", "B", {"k": "id"}, physical_label="A")
    text = "MATCH (a:A)-[:E]->(b:B) WHERE b.name <> 'n1' RETURN b.name AS name, count(*) AS n ORDER BY name"
    assert GraphEngine(spark, one).query(text).collect() == GraphEngine(spark, two, strict_boundaries=False).query(text).collect()
