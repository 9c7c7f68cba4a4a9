"""Every registered query of the subpackage over tables of odd rows, and over tables without rows."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries
from graphloom.llm.common import fold

EXTRA = ", score string, size string, rank string, digest string, head string, accepted int, label string, bin string, taken string, h string, n string, copies string, target string, drawn string"
NAMES = [x.split()[0] for x in EXTRA[2:].split(", ")]
COUNTS = {"op1": "documents", "op2": "documents", "op4": "documents", "op5": "pages", "op6": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op10": "documents"}


def tables(spark, folder, some):
    rng = random.Random(3)
    words = "the of and stone river licensed under the mit license you idiot der die das und nicht $$$ !!! cc by".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 70))), rng.choice(["en", "de", None]), f"s{i % 3}" if i % 7 else None) for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in range(20)]
    docs += [(300, None, "en", "s1"), (301, "", None, None), (302, " \t\n", "de", "s1"), (303, "x" * 200_000, "en", "s2"), (304, "word " * 60_000, "en", "s2"), (305, "Ünï \x00 名前 ▁▁ 😀" * 9, None, "s0")]
    docs += [docs[5]] * 3 + [(None, "no id here at all", "en", "s1")] * 2 + [(None, None, None, None), (7, "another text under an id that stands twice", "de", "s1")]
    big = "<p>é" + "y" * 1500
    pages = [(i, f"http://a/{i}", f"<p>{i}" + "x" * (i * 40)) for i in range(40)] + [(100 + i, "u", big) for i in range(4)]
    pages += [(103, "v", big)] * 3 + [(None, None, big), (None, None, None), (110, None, None), (111, "u\r\nv", "")] + [(111, "u", "")] * 3
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(130)]
    vectors += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 8), (350, []), (400, [2.0]), (None, [1.0] * 8)] + [(50, vectors[50][1]), (131, vectors[3][1]), (132, vectors[3][1])]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(110)] + [(None, 1, 1), (9, None, None), (5, 1, 0), (9999, 0, 1)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string"), ("pages", pages, "page_id long, url string, html string"), ("embeddings", vectors, "vec_id long, embedding array<float>"), ("labels", labels, "doc_id long, quality int, toxic int")):
        own = [x for x in NAMES if name != "labels" or x not in ("label",)]
        more = ", ".join(f"{x} string" for x in own)
        spark.createDataFrame([(*r, *["z"] * len(own)) for r in rows] if some else [], f"{schema}, {more}").repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return folder, {"documents": docs, "pages": pages, "embeddings": vectors}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("odd")), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), False)[0]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    folder, rows = odd
    found = queries.QUERIES[name](spark, folder)
    got = [r.asDict() for r in found.collect()]
    op = name.split("_")[0]
    if op in COUNTS:
        assert len(got) == len(rows[COUNTS[op]])
    key = {"op3": "query_id", "op5": "page_id"}.get(op, "doc_id")
    allowed = {key, *{"op4": ["component_id", "kept"], "op5": ["refers_to"], "op6": ["first_word", "last_word"], "op9": ["pareto_rank"]}.get(op, [])}
    assert all(v is not None for r in got for k, v in r.items() if k not in allowed)
    again = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    if "score" in found.columns and op != "op3":
        assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_pages_against_sql(spark, odd):
    folder, name = odd[0], "op5_warc_dictionary"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_folds_are_told_of_null_ids_too(spark, odd):
    folder, _ = odd
    for name, of, held in (("op2_bradley_terry_quality", 4, 2), ("op7_centroid_language", 5, 0), ("op8_boosted_toxicity", 5, 0)):
        wrong = queries.QUERIES[name](spark, folder).where(~(fold("doc_id", of) == held).eqNullSafe(F.col("held_out")))
        assert wrong.isEmpty()


def test_revisits_of_one_page_in_many_rows(spark, odd):
    folder, rows = odd
    got = [r for r in queries.QUERIES["op5_warc_dictionary"](spark, folder).collect() if r.payload_bytes > 1500 and r.payload_digest == hashlib.sha1(("<p>é" + "y" * 1500).encode()).hexdigest()]
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "response", None), *[(100 + i, "revisit", 103) for i in range(3)], *[(103, "response", None)] * 4]
