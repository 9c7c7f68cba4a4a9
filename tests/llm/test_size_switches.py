"""What depends on a table's size says how a result is found, not what it is."""

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import common, mixing, near_dup, quality

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("bad", [10, 6000, 8000])
def test_every_rejected_document_has_as_many_pairs(bad):
    won, lost = quality.pairs_of(np.array([0] * bad + [1] * 7))
    assert (np.bincount(lost, minlength=bad) == quality.PAIRS_EACH).all() and len(won) == len(lost) and (won >= bad).all()


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
def test_the_pipeline_gives_the_same_beyond_its_bounds(spark, monkeypatch):
    def rows():
        return sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).collect()))

    want = rows()
    for module in (common, near_dup, corpus_pipeline):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    for module, name, value in ((near_dup, "SMALL_BUCKET", 1), (near_dup, "TILE_ROWS", 2), (near_dup, "TILE_GRAMS", 50), (mixing, "PART_ROWS", 2), (common, "BATCH_ROWS", 3), (corpus_pipeline, "BATCH_ROWS", 7)):
        monkeypatch.setattr(module, name, value)
    assert rows() == want
