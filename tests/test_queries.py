"""Every registered graph query against its SQL, and the plans of some."""

import math
from pathlib import Path

import duckdb
import pytest

from graphloom import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        out.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return out


def plain(rows, names):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([one(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_sql(spark, duck, name):
    frame = Q.QUERIES[name](spark, str(DATA))
    want = duck.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert plain(frame.collect(), frame.columns) == plain(want.fetchall(), names)


def test_filters_reach_the_scan(spark):
    plan = Q.QUERIES["virt_last_hop"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "EqualTo(n_name,NATION_3)" in plan
    assert "CartesianProduct" not in plan and "props" not in plan and "c_acctbal" not in plan


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in Q.QUERIES["topk_ties"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_entry_imports_without_the_training_operators():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
