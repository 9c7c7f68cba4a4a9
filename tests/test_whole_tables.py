"""The queries whose pairs are counted against plain Python, and that no query holds to fixed ids."""

import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from graphloom import queries as Q

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
@pytest.mark.parametrize("name", ["rel_unique", "comma_pattern"])
def test_pairs_of_whole_tables(spark, name):
    def rows(table):
        return pq.read_table(DATA / f"{table}.parquet").to_pylist()

    nations, customers = {r["n_nationkey"]: r["n_name"] for r in rows("nation")}, Counter(r["c_nationkey"] for r in rows("customer"))
    others = customers if name == "rel_unique" else Counter(r["s_nationkey"] for r in rows("supplier"))
    want = {nations[k]: n * (n - 1 if name == "rel_unique" else others[k]) for k, n in customers.items()}
    got = {r.n: r.pairs for r in Q.QUERIES[name](spark, str(DATA)).collect()}
    assert got == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("name", sorted(Q.GRAPH_QUERIES))
def test_no_query_holds_to_ids(name):
    ids = r"(?:_custkey|_orderkey|_nationkey|_suppkey|event_id|doc_id)\s*(?:<|<=|=|IN)\s*[\[$\d]"
    found = re.findall(ids, Q.GRAPH_QUERIES[name][0])
    # inline properties, negative ids that no row has, and a condition beside others are what the query is about
    assert not found or name in ("agg_empty",)
