"""Rejection of languages: unlearned ones go, clean texts of a few words stay."""

from pathlib import Path

import pytest

from graphloom.llm import language

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the tables")


@pytest.mark.parametrize("unlearned", ["de", "en", "es", "fr"])
def test_an_unlearned_language_is_rejected_and_clean_texts_stay(spark, unlearned):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(f"doc_id % 3 <> 0 and lang <> '{unlearned}'"))
    held = [(r.lang, r.text) for r in docs.where("doc_id % 3 = 0").collect()]

    def rejected(texts):
        return sum(model.nearest(texts)[2]) / len(texts)

    assert rejected([t for lang, t in held if lang == unlearned]) > 0.95
    assert rejected([t for lang, t in held if lang != unlearned]) < 0.02
    for words in (1, 2, 3, 5):
        assert rejected([" ".join(t.split()[:words]) for lang, t in held if lang != unlearned]) < 0.06


def test_a_few_texts_with_a_wrong_language_make_no_centroid():
    # 98 texts of one kind of word and two of another, all under one name
    texts = [" ".join(f"schön{chr(97 + (i * j) % 26)}" for j in range(30)) for i in range(1, 99)] + ["that thing with them"] * 2
    model = language.fit_centroids(language.np.stack([language.gram_counts(t) for t in texts]), ["de"] * 100)
    assert model.likeness(["that thing with them"])[0][0, 0] < 0.3 < model.likeness([texts[5]])[0][0, 0]


def test_bounds_come_from_all_pieces_of_many_texts(spark):
    """3000 rows, more than once made a text give all of its pieces."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(100).collect() if r.lang and r.text and language.has_letter(r.text)]
    times = 3000 // len(rows) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("@n", language.F.explode(language.F.sequence(language.F.lit(1), language.F.lit(times))))
    model = language.fit(docs)
    counts = language.np.zeros((len(model.names), 2, language.BITS + 1, language.STEPS), int)
    for _, text, lang in rows:
        words = text.split()
        like, length = model.likeness([text, *(x for x in (" ".join(words[: 2**j]) for j in range(9) if 2**j < len(words)) if language.has_letter(x))])
        if model.names[like[0].argmax()] == lang:
            for own, n in zip(like, length, strict=True):
                for k, x in enumerate(own):
                    counts[k, int(model.names[k] == lang), n, min(199, max(0, int(x * 200)))] += times
    assert (model.least == language.bounds(counts)).all()
