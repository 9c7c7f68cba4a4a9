"""Registered queries over the driver's tables: a graph of them, a query for each operator, and the SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphloom.engine import GraphEngine
from graphloom.errors import GraphQueryError
from graphloom.plans.parser import parse
from graphloom.plans.text import text_of
from graphloom.sources.catalog import GraphCatalog, parquet
from graphloom.sources.lookup import LookupSource, Request


@lru_cache(maxsize=16)
def tpch_catalog(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Customers, orders, parts and so on as a graph, events and labels as other sources. A session opens a folder's tables once."""

    @cache
    def loaded(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def read(name: str) -> Callable[[], DataFrame]:
        """A reader of a table that a query may or may not use."""
        return lambda: loaded(name)

    out = GraphCatalog()
    for label, table, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents", "doc_id")):
        out.node(label, read(table), key)
    out.register_source("event-service", read("events"))
    out.register_source("label-service", read("labels"))
    out.node("Event", "Event-Service", "event_id", source="event-service", time_column="ts")
    out.node("LastEvent", "event-service", "event_id", source="event-service", time_column="ts", entity_key="user_id")
    out.node("DocLabel", "label-service", "doc_id", source="label-service")
    out.foreign_key("IN_REGION", "Nation", "Region", "start", "n_regionkey").foreign_key("CUST_IN", "Customer", "Nation", "start", "c_nationkey")
    out.foreign_key("SUPP_IN", "Supplier", "Nation", "start", "s_nationkey").foreign_key("PLACED", "Customer", "Order", "end", "o_custkey")
    out.edge("HAS_PART", "Order", "Part", read("lineitem"), "l_orderkey", "l_partkey").edge("SHIPPED_BY", "Order", "Supplier", read("lineitem"), "l_orderkey", "l_suppkey")
    out.virtual_edge("HAS_EVENT", "Event", {"c_custkey": "user_id"}, physical_label="Customer", last_hop_only=True)
    out.virtual_edge("HAS_LAST", "LastEvent", {"c_custkey": "user_id"}, physical_label="Customer", last_hop_only=True)
    out.virtual_edge("EVENT_OF", "Event", {"c_custkey": "user_id"}, physical_label="Customer", first_hop_only=True)
    out.virtual_edge("LABELLED", "DocLabel", {"doc_id": "doc_id"}, physical_label="Document")
    # a label of several: customers with a debt
    out.node("Debtor", lambda: loaded("customer").where("c_acctbal < 0"), "c_custkey")
    out.node("Quote", read("lineitem"), "l_orderkey", source="quote-service")
    out.virtual_edge("QUOTED", "Quote", {"o_orderkey": "l_orderkey", "o_orderdate": "l_shipdate"}, physical_label="Order")
    out.node("Profile", LookupSource(_profiles, "user long, segment string, score long", "user", searchable=True), "user", source="profile-service")
    out.virtual_edge("HAS_PROFILE", "Profile", {"c_custkey": "user"}, physical_label="Customer", last_hop_only=True, operator="profilesByUser")
    out.virtual_edge("PROFILE_OF", "Profile", {"c_custkey": "user"}, physical_label="Customer", first_hop_only=True, operator="profilesByUser")
    return out


def _profiles(request: Request) -> list[dict]:
    """A source that answers by key or by condition: users 0 to 999, in three segments."""
    users = range(1000) if request.keys is None else (k for k in request.keys if 0 <= k < 1000)
    rows = [{"user": u, "segment": "abc"[u % 3], "score": u * 7 % 100} for u in users]
    return [r for r in rows if all(r[column] == value for column, op, value in request.filters if op == "=")]


_C_N = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
_N_C_E = f"{_C_N} JOIN events e ON e.user_id = c.c_custkey"

#: name: (query, parameters, SQL, whether boundaries of virtual edges are strict)
GRAPH_QUERIES: dict[str, tuple[str, dict[str, Any], str]] = {
    "scan_filter": ("MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS k, c.c_acctbal AS bal", {}, "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "pred_compare": ("MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 AND p.p_retailprice <> 905.0 RETURN p.p_partkey AS k, p.p_size AS s", {}, "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice <> 905.0"),
    "pred_chained": ("MATCH (p:Part) WHERE 5 <= p.p_size < 12 RETURN p.p_partkey AS k", {}, "SELECT p_partkey AS k FROM part WHERE 5 <= p_size AND p_size < 12"),
    "pred_in": ("MATCH (o:Order) WHERE o.o_orderstatus IN ['F', 'O'] AND o.o_orderpriority IN $some RETURN o.o_orderkey AS k", {"some": ["1-URGENT", "5-LOW", 7]}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "pred_string": ("MATCH (n:Nation) WHERE n.n_name STARTS WITH 'NATION_1' OR n.n_name ENDS WITH '3' OR n.n_name CONTAINS 'ON_2' RETURN n.n_name AS name", {}, "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_1') OR ends_with(n_name, '3') OR contains(n_name, 'ON_2')"),
    "pred_null": ("MATCH (c:Customer) WHERE c.c_name IS NOT NULL AND c.nothing IS NULL AND NOT c.c_acctbal IS NULL RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL"),
    "pred_not_or": ("MATCH (c:Customer) WHERE NOT (c.c_acctbal < 0 OR c.c_mktsegment = 'MACHINERY') AND NOT NOT c.c_nationkey > 5 RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'MACHINERY') AND c_nationkey > 5"),
    "pred_label": ("MATCH (o:Order)-[r:HAS_PART|SHIPPED_BY]->(x) WHERE x:Supplier RETURN o.o_orderkey AS k, x.s_suppkey AS s", {}, "SELECT o_orderkey AS k, s_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"),
    "pred_mixed_types": ("MATCH (c:Customer) WHERE c.c_custkey <> 'abc' AND NOT c.c_name = 7 RETURN count(*) AS n", {}, "SELECT count(*) AS n FROM customer"),
    "inline_props": ("MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 3}) RETURN c.c_custkey AS k", {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "inline_param_map": ("MATCH (c:Customer $want) RETURN c.c_custkey AS k", {"want": {"c_mktsegment": "BUILDING", "c_nationkey": 4}}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4"),
    "hop1_fk": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_custkey AS c, o.o_orderkey AS o", {}, "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000"),
    "hop1_left": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer) WHERE n.n_name = 'NATION_3' RETURN n.n_nationkey AS n, c.c_custkey AS c", {}, f"SELECT n.n_nationkey AS n, c.c_custkey AS c FROM {_C_N} WHERE n_name = 'NATION_3'"),
    "hop_both": ("MATCH (n:Nation)-[r]-(x) RETURN n.n_name AS n, r.label AS t, x.label AS l, x.r_name AS region, x.c_custkey AS c", {}, """SELECT n_name AS n, 'IN_REGION' AS t, 'Region' AS l, r_name AS region, CAST(NULL AS BIGINT) AS c FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'CUST_IN', 'Customer', NULL, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT n_name, 'SUPP_IN', 'Supplier', NULL, NULL FROM nation JOIN supplier ON s_nationkey = n_nationkey"""),
    "hop2": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' RETURN c.c_custkey AS c, n.n_name AS n", {}, f"SELECT c.c_custkey AS c, n.n_name AS n FROM {_C_N} JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "hop3": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_IN]-(c:Customer)-[:PLACED]->(o:Order) WHERE r.r_name = 'EUROPE' AND o.o_totalprice > 200000 RETURN r.r_name AS r, c.c_custkey AS c, o.o_orderkey AS o", {}, f"SELECT r_name AS r, c.c_custkey AS c, o_orderkey AS o FROM {_C_N} JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c.c_custkey WHERE r_name = 'EUROPE' AND o_totalprice > 200000"),
    "hop_inferred": ("MATCH (c:Customer)-[:PLACED]->(o)-[:HAS_PART]->(p) RETURN c.c_custkey AS c, o.o_orderkey AS o, p.p_name AS p", {}, "SELECT c_custkey AS c, o_orderkey AS o, p_name AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"),
    "multi_type": ("MATCH (n:Nation)<-[r:CUST_IN|SUPP_IN]-(x) RETURN n.n_nationkey AS n, x.label AS l, count(*) AS cnt", {}, "SELECT n, l, count(*) AS cnt FROM (SELECT c_nationkey AS n, 'Customer' AS l FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) GROUP BY n, l"),
    "edge_props": ("MATCH (o:Order)-[l:HAS_PART]->(p:Part) WHERE l.l_quantity > 45 AND p.p_size < 10 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.l_quantity AS q", {}, "SELECT o_orderkey AS o, p_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 AND p_size < 10"),
    "edge_inline_props": ("MATCH (o:Order)-[l:HAS_PART {l_returnflag: 'R'}]->(p:Part) RETURN o.o_orderkey AS o, p.p_partkey AS p", {}, "SELECT o_orderkey AS o, p_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'"),
    "comma_pattern": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation), (s:Supplier)-[:SUPP_IN]->(n) RETURN n.n_name AS n, count(*) AS pairs", {}, f"SELECT n.n_name AS n, count(*) AS pairs FROM {_C_N} JOIN supplier ON s_nationkey = n.n_nationkey GROUP BY 1"),
    "comma_product": ("MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", {}, "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "two_match": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation) MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 50000 RETURN n.n_name AS n, o.o_orderkey AS o", {}, f"SELECT n.n_name AS n, o_orderkey AS o FROM {_C_N} JOIN orders ON o_custkey = c.c_custkey WHERE o_totalprice > 50000"),
    "two_match_with": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS orders WHERE orders > 12 MATCH (c)-[:CUST_IN]->(n:Nation) RETURN c.c_custkey AS c, orders AS orders, n.n_name AS n", {}, f"SELECT c.c_custkey AS c, orders, n.n_name AS n FROM {_C_N} JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) > 12) ON o_custkey = c.c_custkey"),
    "rel_unique": ("MATCH (a:Customer)-[:CUST_IN]->(n:Nation)<-[:CUST_IN]-(b:Customer) RETURN n.n_name AS n, count(*) AS pairs", {}, "SELECT n_name AS n, count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey JOIN nation ON n_nationkey = a.c_nationkey GROUP BY 1"),
    "agg_global": ("MATCH (o:Order) RETURN count(*) AS n, sum(o.o_totalprice) AS s, avg(o.o_totalprice) AS a, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", {}, "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders"),
    "agg_empty": ("MATCH (o:Order) WHERE o.o_orderkey < 0 RETURN count(o) AS n, sum(o.o_custkey) AS s, avg(o.o_totalprice) AS a", {}, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0"),
    "agg_group": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS seg, o.o_orderstatus AS st, count(*) AS n, max(o.o_totalprice) AS hi", {}, "SELECT c_mktsegment AS seg, o_orderstatus AS st, count(*) AS n, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "agg_distinct": ("MATCH (o:Order)-[l:HAS_PART]->(p:Part) RETURN o.o_orderstatus AS st, count(DISTINCT p.p_brand) AS brands, count(DISTINCT o) AS orders, sum(DISTINCT p.p_size) AS sizes, avg(DISTINCT p.p_size) AS mean", {}, "SELECT o_orderstatus AS st, count(DISTINCT p_brand) AS brands, count(DISTINCT o_orderkey) AS orders, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, avg(DISTINCT p_size) AS mean FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "agg_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(*) AS n, sum(o.o_totalprice) AS s WHERE n > 10 RETURN k AS k, n AS n", {}, "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10"),
    "agg_entity_key": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer) WITH n, avg(c.c_acctbal) AS bal RETURN n.n_name AS n, bal AS bal", {}, f"SELECT n.n_name AS n, avg(c_acctbal) AS bal FROM {_C_N} GROUP BY n.n_nationkey, n.n_name"),
    "with_scope": ("MATCH (c:Customer) WITH c.c_nationkey AS nk, c.c_acctbal AS bal ORDER BY bal DESC, nk LIMIT 100 WITH nk AS nk, max(bal) AS top RETURN nk AS nk, top AS top", {}, "SELECT nk, max(bal) AS top FROM (SELECT c_nationkey AS nk, c_acctbal AS bal FROM customer ORDER BY 2 DESC, 1 LIMIT 100) GROUP BY nk"),
    "distinct_return": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN DISTINCT r.r_name AS r, c.c_mktsegment AS seg", {}, f"SELECT DISTINCT r_name AS r, c_mktsegment AS seg FROM {_C_N} JOIN region ON n_regionkey = r_regionkey"),
    "with_distinct": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation) WITH DISTINCT n RETURN count(*) AS n", {}, f"SELECT count(DISTINCT n_nationkey) AS n FROM {_C_N}"),
    "order_limit": ("MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS k ORDER BY k LIMIT 10", {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY k LIMIT 10"),
    "topk_ties": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size AS s ORDER BY p.p_size DESC, k LIMIT 25", {}, "SELECT p_partkey AS k, p_size AS s FROM part ORDER BY p_size DESC, p_partkey LIMIT 25"),
    "order_hidden": ("MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, o LIMIT 7", {}, "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7"),
    "limit_zero": ("MATCH (o:Order) RETURN o.o_orderkey AS k LIMIT $n", {"n": 0}, "SELECT o_orderkey AS k FROM orders LIMIT 0"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS nk UNION MATCH (s:Supplier) RETURN s.s_nationkey AS nk", {}, "SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS nk UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS nk", {}, "SELECT c_nationkey AS nk FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_branch_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY k LIMIT 3 UNION ALL MATCH (s:Supplier) RETURN s.s_suppkey AS k ORDER BY k DESC LIMIT 2", {}, "(SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 3) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY 1 DESC LIMIT 2)"),
    "union_mixed": ("MATCH (r:Region) RETURN r.r_name AS x UNION ALL MATCH (r:Region) RETURN r.r_name AS x UNION MATCH (n:Nation) RETURN n.n_name AS x", {}, "SELECT r_name AS x FROM region UNION SELECT n_name FROM nation"),
    "virt_last_hop": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) WHERE n.n_name = 'NATION_3' AND e.event_type = 'purchase' RETURN c.c_custkey AS cust, e.event_id AS e", {}, f"SELECT c.c_custkey AS cust, e.event_id AS e FROM {_N_C_E} WHERE n_name = 'NATION_3' AND event_type = 'purchase'"),
    "virt_first_hop": ("MATCH (e:Event)-[:EVENT_OF]->(c:Customer)-[:CUST_IN]->(n:Nation) WHERE e.value > 200 RETURN e.event_id AS e, n.n_name AS n", {}, f"SELECT e.event_id AS e, n.n_name AS n FROM {_N_C_E} WHERE e.value > 200"),
    "virt_mixed": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:PLACED|HAS_EVENT]->(x) RETURN c.c_custkey AS c, x.label AS l, count(*) AS cnt", {}, f"SELECT c, l, count(*) AS cnt FROM (SELECT c.c_custkey AS c, 'Event' AS l FROM {_N_C_E} UNION ALL SELECT c.c_custkey, 'Order' FROM {_C_N} JOIN orders ON o_custkey = c.c_custkey) GROUP BY c, l"),
    "virt_inline_props": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event {event_type: 'click'}) RETURN n.n_name AS n, count(e) AS cnt", {}, f"SELECT n.n_name AS n, count(*) AS cnt FROM {_N_C_E} WHERE event_type = 'click' GROUP BY 1"),
    "virt_agg": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) WITH n.n_name AS n, count(*) AS cnt, max(e.value) AS hi WHERE cnt > 100 RETURN n AS n, cnt AS cnt, hi AS hi ORDER BY cnt DESC, n LIMIT 10", {}, f"SELECT n.n_name AS n, count(*) AS cnt, max(e.value) AS hi FROM {_N_C_E} GROUP BY 1 HAVING count(*) > 100 ORDER BY cnt DESC, 1 LIMIT 10"),
    "virt_relaxed": ("MATCH (d:Document)-[:LABELLED]->(l:DocLabel) WHERE l.quality = 0 RETURN d.doc_id AS d, d.lang AS lang, l.toxic AS toxic", {}, "SELECT d.doc_id AS d, d.lang AS lang, l.toxic AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0"),
    "virt_reversed": ("MATCH (e:Event)<-[:HAS_EVENT]-(c:Customer) RETURN e.event_id AS e, c.c_name AS c", {}, "SELECT event_id AS e, c_name AS c FROM events JOIN customer ON user_id = c_custkey"),
    "snapshot_filter": ("USING SNAPSHOT('latest', $t) ON [Event] MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) RETURN n.n_name AS n, count(*) AS cnt", {"t": 1705000000000}, f"SELECT n.n_name AS n, count(*) AS cnt FROM {_N_C_E} WHERE e.ts <= make_timestamp(1705000000000000) GROUP BY 1"),
    "snapshot_latest": ("USING SNAPSHOT('ffill', 1705000000000) ON [LastEvent] MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_LAST]->(e:LastEvent) RETURN c.c_custkey AS c, e.event_id AS e", {}, "SELECT user_id AS c, event_id AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE ts <= make_timestamp(1705000000000000)) JOIN customer ON c_custkey = user_id WHERE r = 1"),
    "snapshot_nearest": ("USING SNAPSHOT('nearest', 1705000000000) ON ['LastEvent'] MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_LAST]->(e:LastEvent) RETURN c.c_custkey AS c, e.event_id AS e", {}, "SELECT user_id AS c, event_id AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - 1705000000000000), ts, event_id) AS r FROM events) JOIN customer ON c_custkey = user_id WHERE r = 1"),
    "snapshot_other": ("USING SNAPSHOT('s1', 0) ON [Event, Nation] MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) RETURN count(*) AS n", {}, f"SELECT count(*) AS n FROM {_N_C_E}"),
    "param_query": ("MATCH (c:Customer) WHERE c.c_mktsegment = $seg AND c.c_acctbal > $0 RETURN c.c_custkey AS k", {"seg": "BUILDING", 0: 5000}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    "time_compare": ("MATCH (o:Order) WHERE o.o_orderdate < '1995-01-01' AND o.o_orderdate >= $from RETURN count(*) AS n", {"from": 757382400000}, "SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' AND o_orderdate >= make_timestamp(757382400000000)"),
    "several_labels": ("MATCH (c:Customer:Debtor)-[:CUST_IN]->(n:Nation) RETURN c.c_custkey AS c, n.n_name AS n", {}, f"SELECT c.c_custkey AS c, n.n_name AS n FROM {_C_N} WHERE c_acctbal < 0"),
    "composite_keys": ("MATCH (o:Order)-[:QUOTED]->(q:Quote) RETURN o.o_orderkey AS o, q.l_linenumber AS line", {}, "SELECT o_orderkey AS o, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate"),
    "empty_input": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) WHERE c.c_mktsegment = 'NONE' RETURN c.c_custkey AS c, e.event_id AS e", {}, f"SELECT c.c_custkey AS c, e.event_id AS e FROM {_N_C_E} WHERE c_mktsegment = 'NONE'"),
    "bare_boolean": ("MATCH (r:Region) WHERE true AND NOT $off RETURN r.r_name AS r", {"off": False}, "SELECT r_name AS r FROM region"),
    "nested_property": ("MATCH (c:Customer) WITH $want AS w, c WHERE c.c_mktsegment = w.segment.name RETURN c.c_custkey AS k, w.segment.rank AS rank", {"want": {"segment": {"name": "MACHINERY", "rank": 2}}}, "SELECT c_custkey AS k, CAST(2 AS BIGINT) AS rank FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "odd_spelling": ("match (`a customer`:`Customer`)\u2013[:CUST_IN]\u2013>(n:Nation) // a comment\n/* and\nanother */ where `a customer`.`c_acctbal` >= 0x64 return `a customer`.c_custkey as k;", {}, f"SELECT c_custkey AS k FROM {_C_N} WHERE c_acctbal >= 100"),
    "distinct_sorted": ("MATCH (c:Customer)-[:CUST_IN]->(n:Nation) RETURN DISTINCT n AS n ORDER BY n.n_name DESC LIMIT 9", {}, f"SELECT DISTINCT n_nationkey AS id, 'Nation' AS label, n_nationkey, n_name, n_regionkey FROM {_C_N} ORDER BY n_name DESC LIMIT 9"),
    "lookup_by_key": ("MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_PROFILE]->(p:Profile {segment: 'b'}) WHERE p.score >= 50 RETURN n.n_name AS n, count(p) AS users, max(p.score) AS top", {}, f"SELECT n_name AS n, count(*) AS users, CAST(max(c.c_custkey * 7 % 100) AS BIGINT) AS top FROM {_C_N} WHERE c.c_custkey < 1000 AND c.c_custkey % 3 = 1 AND c.c_custkey * 7 % 100 >= 50 GROUP BY 1"),
    "lookup_first_hop": ("MATCH (p:Profile {segment: 'c'})-[:PROFILE_OF]->(c:Customer)-[:CUST_IN]->(n:Nation) RETURN p.user AS u, p.score AS s, n.n_name AS n", {}, f"SELECT c.c_custkey AS u, c.c_custkey * 7 % 100 AS s, n_name AS n FROM {_C_N} WHERE c.c_custkey < 1000 AND c.c_custkey % 3 = 2"),
    "lookup_scan": ("MATCH (p:Profile) WHERE p.segment = 'a' AND p.score < 20 RETURN p.user AS u", {}, "SELECT u FROM (SELECT unnest(range(1000)) AS u) WHERE u % 3 = 0 AND u * 7 % 100 < 20"),
}

RELAXED = {"virt_relaxed", "virt_reversed", "composite_keys", "lookup_scan"}


def _graph(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, params, _ = GRAPH_QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = GraphEngine(spark, tpch_catalog(spark, sf_dir), strict_boundaries=name not in RELAXED).query(text, params)
        return out.select("n.*") if name == "distinct_sorted" else out

    return run


def project_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROJECT BY on every node of a label, its struct flattened."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    return engine.query("MATCH (c:Customer) RETURN c AS c PROJECT BY {Customer: [c_name, c_nationkey]}").select("c.*")


def path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named path, its steps joined to a text."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    paths = engine.query("MATCH p = (r:Region)<-[:IN_REGION]-(n:Nation)<-[:SUPP_IN]-(s:Supplier) WHERE r.r_name = 'ASIA' RETURN p")
    return paths.selectExpr("concat_ws('/', transform(p, x -> concat(x.type, ':', x.label, ':', x.id))) AS p")


def return_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RETURN *: all variables of a row."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    return engine.query("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) RETURN *").selectExpr("n.id AS n", "r.type AS t", "x.r_name AS x")


def entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION of entities of different labels."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    return engine.query("MATCH (x:Region) RETURN x UNION MATCH (x:Nation) RETURN x").selectExpr("x.label AS l", "CAST(x.id AS BIGINT) AS id", "coalesce(x.r_name, x.n_name) AS name")


def path_and_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path beside a node of it."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    found = engine.query("MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN p, n")
    return found.selectExpr("size(p) AS steps", "p[2].id AS region", "n.n_name AS n")


def no_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without RETURN gives all its variables."""
    found = GraphEngine(spark, tpch_catalog(spark, sf_dir)).query("MATCH (s:Supplier)-[r:SUPP_IN]->(n:Nation)")
    return found.selectExpr("s.s_suppkey AS s", "r.type AS t", "n.n_name AS n")


def _records(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def record_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON and records of the same answer, one beside the other."""
    engine, text = GraphEngine(spark, tpch_catalog(spark, sf_dir)), "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n, e, r.r_name AS name"
    records = {r["n"]["_id"]: r for r in engine.execute_records(text)}
    rows = [(j["n"]["id"], j["e"]["type"], j["e"]["endNodeId"], records[j["n"]["id"]]["n"]["_properties"]["n_name"], j["name"]) for j in json.loads(engine.execute(text))]
    return _records(spark, rows, "n long, t string, r long, n_name string, name string")


def implicit_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows come without LIMIT, with another source, and with a LIMIT beyond the cap."""
    engine = GraphEngine(spark, tpch_catalog(spark, sf_dir))
    texts = {"physical": "MATCH (l:Order) RETURN l.o_orderkey AS k", "external": "MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) RETURN e.event_id AS k", "capped": "MATCH (o:Order) RETURN o.o_orderkey AS k LIMIT 9000"}
    return _records(spark, [(k, len(engine.execute_records(t))) for k, t in texts.items()], "of string, n long")


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UNION whose branches return paths: one row of JSON with all of them, limited by branch."""
    text = "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) RETURN p UNION MATCH p = (n:Nation) RETURN p"
    (row,) = json.loads(GraphEngine(spark, tpch_catalog(spark, sf_dir)).execute(text))
    return _records(spark, [(len(p), p[0]["props"]["n_name"]) for p in row["p"]], "steps long, n string")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, by clause, with the code of each."""
    engine, rows = GraphEngine(spark, tpch_catalog(spark, sf_dir)), []
    for name, text in REFUSED.items():
        try:
            engine.query(text)
        except GraphQueryError as e:
            rows.append((name, e.code))
    return _records(spark, rows, "what string, code int")


#: Queries that the language refuses.
REFUSED = {
    "variable length": "MATCH (a:Nation)-[*1..2]->(b) RETURN a",
    "optional match": "MATCH (a:Nation) OPTIONAL MATCH (a)-->(b) RETURN a",
    "pattern predicate": "MATCH (a:Nation) WHERE (a)-->(:Region) RETURN a",
    "case": "MATCH (a:Nation) RETURN CASE WHEN true THEN 1 END AS x",
    "comprehension": "MATCH (a:Nation) RETURN [x IN [1] | x] AS x",
    "indexing": "MATCH (a:Nation) RETURN a.n_name[0] AS x",
    "xor": "MATCH (a:Nation) WHERE true XOR false RETURN a",
    "regexp": "MATCH (a:Nation) WHERE a.n_name REGEXP 'x' RETURN a",
    "function": "MATCH (a:Nation) RETURN size(a.n_name) AS x",
    "skip": "MATCH (a:Nation) RETURN a SKIP 1",
    "explain": "EXPLAIN MATCH (a:Nation) RETURN a",
    "profile": "PROFILE MATCH (a:Nation) RETURN a",
    "create": "CREATE (a:Nation)",
    "set": "MATCH (a:Nation) SET a.x = 1",
    "delete": "MATCH (a:Nation) DELETE a",
    "merge": "MERGE (a:Nation)",
    "unwind": "UNWIND [1] AS x RETURN x",
    "call": "CALL p()",
    "call in query": "MATCH (a:Nation) CALL p() YIELD x RETURN x",
    "start label": "MATCH (a) RETURN a",
    "empty": " ",
    "two sources": "MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event) RETURN count(c) AS a, count(e) AS b",
    "virtual hop in the middle": "MATCH (n:Nation)<-[:CUST_IN]-(c:Customer)-[:HAS_EVENT]->(e:Event)-[:EVENT_OF]->(d:Customer) RETURN c",
    "distinct sort": "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s ORDER BY c.c_acctbal",
    "columns of a union": "MATCH (a:Nation) RETURN a.n_name AS x UNION MATCH (a:Nation) RETURN a.n_name AS y",
    "unknown label": "MATCH (a:Nowhere) RETURN a",
    "unknown edge": "MATCH (a:Nation)-[:NOWHERE]->(b) RETURN a",
    "missing parameter": "MATCH (a:Nation) WHERE a.n_name = $x RETURN a",
}
#: Codes other than that of the parser.
_CODES = {"virtual hop in the middle": 2001, "unknown label": 4001, "unknown edge": 4001, "missing parameter": 1003}


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement written out as text again and run."""
    text = GRAPH_QUERIES["virt_agg"][0]
    return GraphEngine(spark, tpch_catalog(spark, sf_dir)).query(text_of(parse(text)))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources answer."""
    catalog = GraphCatalog()
    catalog.register_source("Events", parquet(spark, f"{sf_dir}/events.parquet"))
    catalog.register_source("gone", parquet(spark, f"{sf_dir}/there-is-no-such-table.parquet"))
    return _records(spark, [(name, catalog.healthy(name)) for name in ("EVENTS", "gone")], "source string, healthy boolean")


def raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass-through of native text."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation_raw")
    return GraphEngine(spark, tpch_catalog(spark, sf_dir)).sql("SELECT n_regionkey AS r, count(*) AS n FROM nation_raw GROUP BY n_regionkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _graph(name) for name in GRAPH_QUERIES} | {f.__name__: f for f in (project_by, path_nodes, path_and_node, no_return, return_star, entity_union, record_sinks, implicit_limits, path_rows, refusals, text_round_trip, source_health, raw_sql)}

SQL = {name: sql for name, (_, _, sql) in GRAPH_QUERIES.items()} | {
    "project_by": "SELECT 'Customer' AS label, c_name, c_nationkey FROM customer",
    "path_nodes": "SELECT 'node:Region:' || r_regionkey || '/edge:IN_REGION:' || n_nationkey || '/node:Nation:' || n_nationkey || '/edge:SUPP_IN:' || s_suppkey || '/node:Supplier:' || s_suppkey AS p FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'",
    "return_star": "SELECT n_nationkey AS n, 'IN_REGION' AS t, r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey",
    "entity_union": "SELECT 'Region' AS l, CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION SELECT 'Nation', n_nationkey, n_name FROM nation",
    "path_and_node": "SELECT 3 AS steps, CAST(n_regionkey AS VARCHAR) AS region, n_name AS n FROM nation",
    "no_return": "SELECT s_suppkey AS s, 'SUPP_IN' AS t, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "record_sinks": "SELECT CAST(n_nationkey AS BIGINT) AS n, 'IN_REGION' AS t, CAST(n_regionkey AS BIGINT) AS r, n_name, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "implicit_limits": f"SELECT 'physical' AS of, least(count(*), 5000) AS n FROM orders UNION ALL SELECT 'external', least(count(*), 1000) FROM {_N_C_E} UNION ALL SELECT 'capped', least(count(*), 8000) FROM orders",
    "path_rows": "SELECT CAST(3 AS BIGINT) AS steps, n_name AS n FROM nation UNION ALL SELECT 1, n_name FROM nation",
    "refusals": "SELECT what, CAST(code AS INTEGER) AS code FROM (VALUES " + ", ".join(f"('{k}', {_CODES.get(k, 1001)})" for k in REFUSED) + ") t(what, code)",
    "text_round_trip": GRAPH_QUERIES["virt_agg"][2],
    "source_health": "SELECT * FROM (VALUES ('EVENTS', true), ('gone', false)) t(source, healthy)",
    "raw_sql": "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' purchases by nation, over a graph and another source."""
    return QUERIES["virt_agg"](spark, sf_dir)
