"""Mixing of as many words as large tables have."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing


@pytest.mark.parametrize("size", [400_000_000, 2_000_000_000])
def test_words_beyond_an_int(spark, size):
    """Three times 800 million words exceed an int, though the words themselves do not."""
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, source string, text string")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.pareto_mix(docs, F.lit(size)).collect()}
    assert got == {1: (size, 2.0 * size, 2 * size), 2: (size, 1.0 * size, size)}
