"""Toxicity by gradient-boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.llm.common import column_of, labelled_sample, map_arrow

#: Labelled documents that a fit uses at most, entries of the learned lexicon, folds of the cross-fit, words around a hit that are near it.
SAMPLE, LEXICON, FOLDS, NEAR = 10_000, 3000, 4, 4
#: Lengths of word beginnings that may be lexicon entries, beside whole words.
STEMS = (3, 4, 5, 6, 7)

# A general list of insults, and words that address the reader.
INSULTS = "idiot moron stupid dumb trash garbage scum loser pathetic worthless disgusting clown jerk fool imbecile bastard vermin filth".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted tus vosotros".split()

#: Bytes of a word: ASCII letters, lower-cased, and all beyond ASCII. Bytes that may stand for letters or between the letters of a disguised word.
LETTERS = X.byte_mask([(65, 90), (97, 122), (128, 255)])
DISGUISE = X.byte_mask([(48, 57), (33, 33), (36, 36), (42, 43), (45, 46), (64, 64)])
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEET = bytes.maketrans(b"013457@$!+", b"oieastasit")
_CLASSES = {"upper": X.byte_mask([(65, 90)]), "letter": X.byte_mask([(65, 90), (97, 122)]), "!": X.byte_mask([(33, 33)]), "?": X.byte_mask([(63, 63)]), "symbol": X.byte_mask([(35, 38), (42, 42), (64, 64)])}


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").translate(_LOWER))


def stems(word: bytes) -> set[str]:
    """The entries that a word may stand under: itself after "=", and its beginnings. They are bytes shown as Latin-1."""
    shown = word.decode("latin-1")
    return {"=" + shown, *(shown[:n] for n in STEMS if len(shown) >= n)}


class Table:
    """Weights by 64-bit hash."""

    def __init__(self, weights: dict[bytes, float]):
        hashes = np.array([X.word_hashes(w, LETTERS)[0] for w in weights], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.array(list(weights.values()), float)[order]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The weight of each, 0 if it has none."""
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], 0.0)


class Lexicon:
    """Weight of a word: the largest of the entries that it is or begins with; 0 if none."""

    def __init__(self, entries: dict[str, float]):
        named = [(k.encode("latin-1"), v) for k, v in entries.items()]
        self.whole = Table({k[1:]: v for k, v in named if k[:1] == b"="})
        self.begun = {n: Table({k: v for k, v in named if k[:1] != b"=" and len(k) == n}) for n in STEMS}

    def weights(self, words: X.Words, which: np.ndarray) -> np.ndarray:
        """The weights of some words."""
        out, length = self.whole(words.hash[which]), words.length[which]
        for n, table in self.begun.items():
            long = np.flatnonzero(length >= n)
            if len(table.hashes) and len(long):
                out[long] = np.maximum(out[long], table(words.beginnings(which[long], n)))
        return out


_SEED, _SECOND = Table({w.encode(): 1.0 for w in INSULTS}), Table({w.encode(): 1.0 for w in SECOND_PERSON})


def features(texts: pa.Array, learned: Lexicon) -> np.ndarray:
    """Lexicon densities, nearness of second-person words, capitals, punctuation, repetition and disguise rates, a row for each text; all 0 for an empty or null text."""
    return np.concatenate([np.zeros((0, WIDTH)), *(_chunk(data, offsets, learned) for _, _, data, offsets in X.string_chunks(texts))])


def _chunk(data: np.ndarray, offsets: np.ndarray, learned: Lexicon) -> np.ndarray:
    texts, words = len(offsets) - 1, X.Words(data, offsets, LETTERS)
    _, some, same = np.unique(words.hash, return_index=True, return_inverse=True)
    weight, insult, person = learned.weights(words, some)[same], _SEED(words.hash[some])[same], _SECOND(words.hash[some])[same]

    def by_text(of: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, values, texts).astype(float)

    n, w = np.maximum(1, np.diff(offsets)), np.maximum(1, words.count)
    count = {k: X.count_by_text(mask[data], offsets) for k, mask in _CLASSES.items()}
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] > 64)
        for ahead in (0, 1):  # not over the beginning of a text
            triple[np.minimum(offsets[:-1] + ahead, len(data) - 1)] = False
    hits = np.flatnonzero(weight > 0)
    of, hit_weight = words.text[hits], weight[hits]
    many = by_text(of)
    # second-person words up to NEAR words away in the same text
    persons = np.concatenate([[0], np.cumsum(person > 0)])
    low, high = np.maximum(words.first[of], hits - NEAR), np.minimum(words.first[of + 1], hits + NEAR + 1)
    near = by_text(of[persons[high] > persons[low]])
    top = np.zeros(texts)
    np.maximum.at(top, of, hit_weight)
    # each hit word once a text, heaviest first
    order = np.lexsort((words.hash[hits], -hit_weight, of))
    kinds = np.stack([of[order].astype(np.uint64), words.hash[hits][order]])
    once = order[np.concatenate([[True], (kinds[:, 1:] != kinds[:, :-1]).any(axis=0)])[: len(order)]]
    distinct = by_text(of[once])
    place = np.arange(len(once)) - np.searchsorted(of[once], of[once])
    three = by_text(of[once][place < 3], hit_weight[once][place < 3])
    hidden, hidden_hits = _disguised(data, words, learned, texts)
    total = by_text(of, hit_weight)
    insults = by_text(words.text, insult)
    share = np.divide(np.log1p(distinct), np.log1p(many), out=np.zeros(texts), where=many > 0)
    return np.stack([
        insults / w, np.log1p(insults), many / w, np.log1p(many), distinct, share,
        total / w, np.log1p(total), top, three,
        by_text(words.text, person) / w, near / w, near / np.maximum(1, many), count["upper"] / np.maximum(1, count["letter"]), count["!"] / n, count["?"] / n,
        count["symbol"] / n, X.count_by_text(triple, offsets) / n, hidden / w, hidden_hits, np.log1p(words.count),
    ], axis=1)


def _disguised(data: np.ndarray, words: X.Words, learned: Lexicon, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of runs of words that only digits and signs part, as in st*p1d, and of those that are in a lexicon when read as letters."""
    hidden, found = np.zeros(texts), np.zeros(texts)
    end = words.start + words.length
    plain = np.concatenate([[0], np.cumsum(~DISGUISE[data])])
    linked = np.flatnonzero((words.text[1:] == words.text[:-1]) & (plain[words.start[1:]] == plain[end[:-1]]))
    if not len(linked):
        return hidden, found
    first = linked[np.concatenate([[True], linked[1:] != linked[:-1] + 1])]
    last = linked[np.concatenate([linked[1:] != linked[:-1] + 1, [True]])] + 1
    np.add.at(hidden, words.text[first], 1)
    raw = data.tobytes()
    read = [raw[a:b].translate(_LOWER).translate(_LEET, b"*.-") for a, b in zip(words.start[first].tolist(), end[last].tolist(), strict=True)]
    joined = X.Words(np.frombuffer(b"".join(read), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in read])]), LETTERS)
    # what is still not one word is none
    one = np.flatnonzero(joined.count == 1)
    one = one[joined.length[joined.first[one]] == np.array([len(r) for r in read])[one]]
    at = joined.first[one]
    hit = (learned.weights(joined, at) > 0) | (_SEED(joined.hash[at]) > 0)
    np.add.at(found, words.text[first[one[hit]]], 1)
    return hidden, found


WIDTH = 21


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features: for each tree and inner node a feature and a bin, for each leaf a value."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of quantile bins. ``least`` is the smallest sum of second derivatives on a side of a split."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    share = (label.sum() + 0.5) / (len(label) + 1)
    start = float(np.log(share / (1 - share)))
    margin, width = np.full(len(x), start), x.shape[1]
    all_features, all_splits, leaves = [], [], []
    for _ in range(trees if len(set(label)) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - label, p * (1 - p)
        node = np.zeros(len(x), int)
        feature, split = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins, int)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * width + np.arange(width)) * bins + binned
            gs, hs = (np.bincount(slot.ravel(), np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                if gain[k].ravel()[best[k]] > 1e-9:
                    feature[first + k], split[first + k] = divmod(int(best[k]), bins)
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > split[node])
        node -= 2**depth - 1
        gl, hl = (np.bincount(node, v, 2**depth) for v in (g, h))
        leaf = -rate * gl / (hl + ridge)
        margin += leaf[node]
        all_features.append(feature)
        all_splits.append(split)
        leaves.append(leaf)
    shape = (len(leaves), 2**depth - 1)
    return Trees(edges, start, np.array(all_features, int).reshape(shape), np.array(all_splits, int).reshape(shape), np.array(leaves).reshape(len(leaves), 2**depth))


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, probability) of the non-decreasing step function of least squares, by pooling of adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest, highest margin
    for m, y in zip(margin[order], label[order], strict=True):
        blocks.append([float(y), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], hi]
    points = [(m, s / w) for s, w, lo, hi in blocks for m in dict.fromkeys((lo, hi))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


@dataclass
class Model:
    entries: dict[str, float]
    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a small share of the plain one orders equal steps."""
        margin = self.trees.margin(x)
        plain = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        fitted = np.interp(margin, self.at, self.probability) if len(self.at) else plain
        return np.clip(0.98 * fitted + 0.02 * plain, 0, 1)


def weigh(toxic: dict[str, float], clean: dict[str, float], toxics: float, cleans: float) -> dict[str, float]:
    """Entries that at least 3 toxic documents have and that are rare in clean ones, with their log odds; a longer beginning that says no more than a shorter one is left out."""
    out = {}
    for s, t in toxic.items():
        odds = np.log((t + 0.2) / (toxics + 1)) - np.log((clean.get(s, 0) + 0.2) / (cleans + 1))
        if t >= 3 and odds > 2:
            out[s] = float(odds)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, label, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = sorted(set().union(*map(stems, set(words_of(text)))))
            k = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([doc % FOLDS] * k, pa.int32()), pa.array([label] * k, pa.int32())], names=["stem", "fold", "label"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, label); it uses at most ``sample`` labelled documents, those of least hash.

    An id's largest label and least text count; labels other than 0 and 1, of a null id or of no document are left out.
    Without labels of both kinds the model gives every text the share of toxic ones; null texts are empty, extra columns
    are not read. Lexicon entries are counted by fold, so that a training document's lexicon features come from the other folds, and
    the margins that calibrate are those of trees that have not seen the document.
    """
    rows = labelled_sample(docs, labels, sample, "toxic").select(F.col("doc_id"), "label", "text")
    known = rows.select("doc_id", "label").collect()  # at most ``sample`` rows, one of each id
    fold = np.array([r.doc_id % FOLDS for r in known], int)
    label = np.array([r.label for r in known], int)
    per = [F.sum(((F.col("fold") == f) & (F.col("label") == v)).cast("int")).alias(f"n{v}{f}") for v in (0, 1) for f in range(FOLDS)]
    counted = map_arrow(rows, _counts, "stem string, fold int, label int").groupBy("stem").agg(*per)
    toxic, clean = sum(F.col(f"n1{f}") for f in range(FOLDS)), sum(F.col(f"n0{f}") for f in range(FOLDS))
    toxics, cleans = int((label == 1).sum()), int((label == 0).sum())
    odds = F.log((toxic + 0.2) / F.lit(toxics + 1.0)) - F.log((clean + 0.2) / F.lit(cleans + 1.0))
    found = counted.where((toxic >= 3) & (odds > 1.5)).orderBy((odds * F.sqrt(toxic)).desc(), "stem").limit(LEXICON).collect()

    def entries(out: int | None) -> dict[str, float]:
        use = [f for f in range(FOLDS) if f != out]
        inside = np.isin(fold, use)
        return weigh({r.stem: sum(r[f"n1{f}"] for f in use) for r in found}, {r.stem: sum(r[f"n0{f}"] for f in use) for r in found}, float((label[inside] == 1).sum()), float((label[inside] == 0).sum()))

    lexicons = [entries(f) for f in range(FOLDS)]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(e) for e in lexicons]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            x = np.zeros((len(ids), WIDTH))
            for f in set((ids % FOLDS).tolist()):
                rows = np.flatnonzero(ids % FOLDS == f)
                x[rows] = features(batch.column("text").take(pa.array(rows)), own[f])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = map_arrow(rows, featured, "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: r.doc_id)
    x, y, f = np.array([r.x for r in got]).reshape(len(got), WIDTH), np.array([r.label for r in got], int), np.array([r.doc_id % FOLDS for r in got], int)
    margin = np.zeros(len(x))
    for k in range(FOLDS):
        margin[f == k] = boost(x[f != k], y[f != k]).margin(x[f == k])
    at, probability = isotonic(margin, y)
    return Model(entries(None), boost(x, y), at, probability)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a column score (0 to 1) added, in place of one that it has.

    A null text counts as empty. Every row is scored by itself, so repeated rows have equal scores, ids may be null, very
    long texts only take time, and an empty table stays empty.
    """
    return docs.withColumn("score", column_of(_Scorer(docs.sparkSession.sparkContext.broadcast(model)), "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))


class _Scorer:
    """Scores texts; a worker makes its lexicon once."""

    def __init__(self, shared):
        self.shared, self.learned = shared, None

    def __call__(self, texts: pa.Array) -> pa.Array:
        self.learned = self.learned or Lexicon(self.shared.value.entries)
        x = features(texts, self.learned)
        return pa.array(self.shared.value.score(x) if len(x) else [], pa.float64())
