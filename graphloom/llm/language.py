"""Language identification by nearest centroids of normalised TF-IDF character n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column_of, cut, map_arrow

#: Labelled documents of a language that its centroids come from at most, centroids of a language, hashed dimensions, steepness of the score.
SAMPLE, CENTROIDS, BITS, STEEP = 500, 3, 13, 25.0
#: Share of a language's sample that a centroid must hold, so that a few texts with a wrong language make none.
HELD = 0.05
#: Steps of likeness in which it is counted, quantile of own and of foreign likeness that bounds a language.
STEPS, EDGE = 200, 0.01
#: Pieces of 1, 2, 4 ... words that every training text also gives.
PIECES = 9
#: Documents of a language that are ranked for its sample, as a multiple of the sample, and the most languages: a centroid has 32 KB.
SPARE, LANGUAGES = 2, 2000
UNKNOWN = "und"
_BLANK = np.arange(256, dtype=np.uint32)
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed runs of two and three bytes of the lower-cased text, all ASCII but letters as blanks."""
    data = _BLANK[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    two = data[:-1] << np.uint32(8) | data[1:]
    three = two[:-1] << np.uint32(8) | data[2:]
    keep = np.concatenate([two[two != 0x2020] | np.uint32(1 << 24), three[(three >> 8 != 0x2020) & (three & 0xFFFF != 0x2020)]])
    return np.bincount(keep * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=1 << BITS)


def pieces(text: str) -> list[str]:
    """Beginnings of 1, 2, 4 ... words of a text, of all PIECES lengths that are shorter than it."""
    words = text.split(None, 1 << PIECES - 1)
    return [" ".join(words[:n]) for n in (1 << j for j in range(PIECES)) if n < len(words)]


@dataclass
class Centroids:
    """Unit centroids with their languages, and by language and length of a text the likeness to its nearest centroid that the text needs.

    A text's length is the whole part of the binary logarithm of its distinct runs.
    """

    idf: np.ndarray
    names: list[str]
    of: np.ndarray
    vectors: np.ndarray
    least: np.ndarray

    @cached_property
    def by_gram(self) -> np.ndarray:
        return np.ascontiguousarray(self.vectors.T)

    def likeness(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Likeness of each text to the nearest centroid of each language, and each text's length; only the dimensions that a text has are multiplied."""
        like, length = np.zeros((len(texts), len(self.vectors)), np.float32), np.zeros(len(texts), int)
        for i, text in enumerate(texts):
            counts = gram_counts(text)
            at = np.flatnonzero(counts)
            own = (np.log1p(counts[at]) * self.idf[at]).astype(np.float32)
            like[i] = own @ self.by_gram[at] / max(1e-9, float(np.linalg.norm(own)))
            length[i] = max(0, len(at).bit_length() - 1)
        starts = np.flatnonzero(np.diff(self.of, prepend=-1))  # centroids of a language stand together
        return np.maximum.reduceat(like, starts, axis=1), length

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether it is rejected as far from all centroids) of each text."""
        out, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows and self.names:
            by_name, length = self.likeness([texts[i] for i in rows])
            best = by_name.argmax(axis=1)
            weight = np.exp(STEEP * (by_name - by_name.max(axis=1, keepdims=True)))
            for j, i in enumerate(rows):
                out[i], score[i], far[i] = self.names[best[j]], weight[j, best[j]] / weight[j].sum(), by_name[j, best[j]] < self.least[best[j], length[j]]
        return out, score, far


def weights_of(documents: int, having: np.ndarray) -> np.ndarray:
    """Inverse document frequencies from the number of documents and of those with each dimension."""
    return (np.log((1 + documents) / (1 + having)) + 1).astype(np.float32)


def centres_of(counts: np.ndarray, idf: np.ndarray, centroids: int = CENTROIDS) -> np.ndarray:
    """Clusters a language's TF-IDF vectors on the unit sphere.

    The first centre is the vector of middle likeness to the mean, each further one a vector far from those before, but
    with a tenth of the vectors still farther. A centre that holds few vectors in the end is left out.
    """
    own = np.log1p(counts).astype(np.float32) * idf
    own /= np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))
    centres = [own[np.argsort(own @ own.mean(axis=0), kind="stable")[len(own) // 2]]]
    while len(centres) < min(centroids, len(own)):
        centres.append(own[np.argsort((own @ np.stack(centres).T).max(axis=1), kind="stable")[len(own) // 10]])
    now = np.stack(centres)
    for _ in range(10):
        near = (own @ now.T).argmax(axis=1)
        now = np.stack([own[near == c].mean(axis=0) if (near == c).any() else now[c] for c in range(len(now))])
        now /= np.maximum(1e-9, np.linalg.norm(now, axis=1, keepdims=True))
    return now[np.bincount((own @ now.T).argmax(axis=1), minlength=len(now)) >= max(1, HELD * len(own))]


def model_of(idf: np.ndarray, found: list[tuple[str, np.ndarray]]) -> Centroids:
    """A model of the centres (language, vector); nothing is rejected before ``bounds`` are set."""
    names = sorted({name for name, _ in found})
    order = sorted(range(len(found)), key=lambda i: found[i][0])
    vectors = np.stack([found[i][1] for i in order]) if found else np.zeros((0, 1 << BITS), np.float32)
    return Centroids(idf, names, np.array([names.index(found[i][0]) for i in order], int), vectors, np.zeros((len(names), BITS + 1)))


def fit_centroids(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Centroids:
    """A model of texts that are all at hand."""
    idf = weights_of(len(counts), (counts > 0).sum(axis=0))
    return model_of(idf, [(name, v) for name in sorted(set(langs)) for v in centres_of(counts[[i for i, x in enumerate(langs) if x == name]], idf, centroids)])


def tally(model: Centroids, texts: list[str], langs: list[str]) -> np.ndarray:
    """Numbers of texts and pieces by language, whether it is their own, length, and step of their likeness to the language.

    A text that lies nearest to another language than its own may be named wrongly, so it counts nowhere.
    """
    out = np.zeros((len(model.names), 2, BITS + 1, STEPS), np.int64)
    for text, lang in zip(texts, langs, strict=True):
        if lang not in model.names or not has_letter(text):
            continue
        by_name, length = model.likeness([text, *filter(has_letter, pieces(text))])
        own = model.names.index(lang)
        if by_name[0].argmax() == own:
            step = np.clip((by_name * STEPS).astype(int), 0, STEPS - 1)
            for k in range(len(model.names)):
                np.add.at(out, (k, int(k == own), length, step[:, k]), 1)
    return out


def bounds(counts: np.ndarray) -> np.ndarray:
    """The least likeness by language and length, from ``tally``: midway between the low end of the own and the high end of the foreign.

    Where the two overlap, as with a word or two, it is the low end of the own, so that clean short texts stay. Lengths
    that no own text has take the bound of the next shorter one.
    """
    out = np.zeros((len(counts), BITS + 1))
    for k, (foreign, own) in enumerate(counts):
        for n in range(BITS + 1):
            if own[n].any():
                low = (np.cumsum(own[n]) > EDGE * own[n].sum()).argmax() / STEPS
                high = ((np.cumsum(foreign[n]) >= (1 - EDGE) * foreign[n].sum()).argmax() + 1) / STEPS if foreign[n].any() else 0.0
                out[k, n] = min(low, (low + high) / 2)
            elif n:
                out[k, n] = out[k, n - 1]
    return out


def _tallied(model):
    """Of (lang, text): the cells of ``tally`` that are not 0, once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum((tally(model.value, b.column("text").to_pylist(), b.column("lang").to_pylist()) for b in batches), np.zeros((len(model.value.names), 2, BITS + 1, STEPS), np.int64)).ravel()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["at", "n"])

    return run


def _having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text): the number of texts with letters (at -1) and of those that have each dimension, once a partition."""
    found, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in filter(has_letter, batch.column("text").to_pylist()):
            found += gram_counts(text) > 0
            texts += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int64()), pa.array(np.append(texts, found[at]), pa.int64())], names=["at", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, h, text): the dimensions that a text has, and their counts, so that very long texts travel no farther."""
    for batch in batches:
        counts = [gram_counts(t) for t in batch.column("text").to_pylist()]
        at = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(at, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(counts, at, strict=True)], pa.list_(pa.int32()))], names=["lang", "h", "at", "n"])


def _clustered(idf: np.ndarray):
    """Of one language's sample from ``_sparse``: its centres."""

    def run(rows: pa.Table) -> pa.Table:
        counts = np.zeros((rows.num_rows, 1 << BITS), np.float32)
        for own, r in zip(counts, np.argsort(rows["h"].to_numpy(), kind="stable"), strict=True):
            own[rows["at"][r].values.to_numpy()] = rows["n"][r].values.to_numpy()
        own = centres_of(counts, idf)
        return pa.table([pa.array([rows["lang"][0].as_py()] * len(own), pa.string()), pa.array(list(own), pa.list_(pa.float32()))], names=["lang", "vector"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> Centroids:
    """A model from (doc_id, text, lang).

    It learns from the rows whose lang is not null and whose text has letters; rows that repeat lang, doc_id and text
    count once in the sample. Centroids come from at most ``sample`` documents of each language, those of least hash of
    doc_id and text, clustered in one task a language; document frequencies and the bounds of rejection from all
    documents (the bounds also from pieces of them). The driver gathers up to CENTROIDS vectors a language, and more
    than LANGUAGES of these raise, so that the model is under 200 MB. Without such rows nothing is learned, and every
    text is ``und``. Null ids are ids like others; extra columns are not read.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text", F.lit("language")).alias("h"))
    sizes = cut(named.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")))
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    held = {r["at"]: r["n"] for r in map_arrow(named.select("text"), _having, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    having = np.zeros(1 << BITS, np.int64)
    for at, n in held.items():
        if at >= 0:
            having[at] = n
    idf = weights_of(held.get(-1, 0), having)
    # hashes above some multiple of the wanted share are left out first, so that a language of most rows is ranked by no single task
    near = named.join(F.broadcast(sizes), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("d") <= SPARE * sample)
    order = Window.partitionBy("lang").orderBy("h")
    chosen = cut(near.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("lang", "h"))
    rows = named.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    found = map_arrow(rows, _sparse, "lang string, h long, at array<int>, n array<int>").groupBy("lang").applyInArrow(_clustered(idf), "lang string, vector array<float>").collect()
    model = model_of(idf, sorted(((r["lang"], np.array(r["vector"], np.float32)) for r in found), key=lambda x: (x[0], x[1].tobytes())))
    if model.names:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        cells = map_arrow(named.select("lang", "text"), _tallied(shared), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        tallied = np.zeros((len(model.names), 2, BITS + 1, STEPS), np.int64)
        tallied.ravel()[[r["at"] for r in cells]] = [r["n"] for r in cells]
        model.least = bounds(tallied)
    return model


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` with columns lang_pred, score and rejected added, in place of such that it has.

    A null text or one without letters gives ``und``, score 0, rejected. Any other text gives the language of its
    nearest centroid, and is rejected if its likeness is under the least that this language calls for in a text of this
    length. Every row is taken by itself: repeated rows agree, ids may be null, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def nearest(texts: pa.Array) -> pa.Array:
        names, score, far = shared.value.nearest([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["lang", "score", "rejected"])

    out = docs.withColumn("@found", column_of(nearest, "lang string, score double, rejected boolean")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.withColumns({"lang_pred": F.col("`@found`.lang"), "score": F.col("`@found`.score"), "rejected": F.col("`@found`.rejected")}).drop("@found")
