"""The pipeline's stages, and the queries that SQL expresses."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import near_dup, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the tables")


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "'x' AS score", "1 AS accepted")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "tokens" or docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[4] == counts[5]
    kept = spark.read.parquet(f"{tmp_path}/language")
    groups = near_dup.near_duplicates(kept, 5)
    left = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/near_dedup").select("doc_id").collect()}
    assert left == {r.component_id for r in groups.collect()}
    assert {r.score for r in spark.read.parquet(f"{tmp_path}/mixing").select("score").collect()} == {"x"}


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = queries.QUERIES[name](spark, str(DATA))
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))
