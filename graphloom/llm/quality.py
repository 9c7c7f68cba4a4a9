"""Document quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column_of, labelled_sample, map_arrow

#: Labelled documents that a fit uses at most, pairs for each rejected document, ridge penalty, score at the threshold.
SAMPLE, PAIRS_EACH, RIDGE, CUT = 8000, 20, 1e-3, 0.7
#: Bins of equal width in which the utilities of all documents are counted, and the utility beyond which all fall in the last one.
BINS, WIDEST = 1 << 16, 64.0
_SENTENCE, _MARKS, _BRACKETS = b".,;:'\"-", b"!?", b"()[]{}<>"


def features(text: str) -> np.ndarray:
    """Rates of kinds of characters, repetition of words and lines, and length; all 0 for an empty text but the length."""
    data = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    upper, lower, digits, beyond = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    sentence, marks, brackets = (count[list(x)].sum() for x in (_SENTENCE, _MARKS, _BRACKETS))
    blank, lines = count[32] + count[9], count[10] + count[13]
    symbols = max(0, len(data) - upper - lower - digits - beyond - sentence - marks - brackets - blank - lines)
    words, own_lines = text.split(), [x for x in text.split("\n") if x]
    w = max(1, len(words))
    again = sum(map(eq, words, islice(words, 1, None))) / w
    rates = np.array([
        symbols / n, count[124] / n, marks / n, sentence / n, brackets / n, digits / n, upper / max(1, upper + lower), beyond / n, lines / n,
        again, 1 - len(set(words)) / w, 1 - len(set(own_lines)) / max(1, len(own_lines)), symbols / w, marks / w, min(3.0, len(data) / w / 10),
    ])
    return np.concatenate([rates, np.sqrt(rates), rates > 0.02, rates > 0.1, [np.log1p(w) / 10, len(words) < 3]])


@dataclass
class Ranker:
    """Linear utility of standardised features, the log odds of label 1 as ``slope`` * utility + ``base``, and the utility at which a document is accepted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 0.0
    base: float = 0.0
    threshold: float = 0.0

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -10, 10) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, CUT at the threshold."""
        return _logistic(self.utility(x) - self.threshold + np.log(CUT / (1 - CUT)))


def _logistic(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int) -> np.ndarray:
    """Weights of least logistic loss of labels ``y`` plus a ridge penalty for each weight."""
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _logistic(x @ weights)
        gradient = ridge * weights + x.T @ (p - y) / len(x)
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        weights -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-4:
            break
    return weights


def pairs_of(label: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places of the better and of the worse document of each preference pair: every rejected one loses to PAIRS_EACH accepted ones drawn at random."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    losers = np.repeat(bad, PAIRS_EACH)
    return np.random.default_rng(seed).choice(good, len(losers)), losers


def fit_pairs(x: np.ndarray, label: np.ndarray, seed: int = 7) -> Ranker:
    """Learns utilities from pairs of an accepted and a rejected document, and the odds of the labels along them; the threshold is not set yet.

    Labels of one kind only, or none: every document has utility 0, and odds of that kind, without labels of 1.
    """
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale[scale < 1e-9] = 1.0
    won, lost = pairs_of(label, seed)
    if not len(won):
        return Ranker(mean, scale, np.zeros(x.shape[1]), 0.0, -30.0 if (label == 0).any() else 30.0)
    z = np.clip((x - mean) / scale, -10, 10)
    ahead = z[won]
    ahead -= z[lost]
    weights = _newton(ahead, np.ones(len(won)), np.full(x.shape[1], RIDGE), 25)
    slope, base = _newton(np.stack([z @ weights, np.ones(len(z))], axis=1), label.astype(float), np.array([1e-4, 0.0]), 60)
    return Ranker(mean, scale, weights, float(slope), float(base))


def quantile_threshold(ranker: Ranker, counts: np.ndarray) -> tuple[float, float]:
    """(level, threshold) from the numbers of documents by bin of utility.

    The level is the share of all documents that the labels let expect to be 0, the mean of the odds' probabilities; the
    threshold is the utility quantile of that level: the bound between bins below which the share of documents comes
    nearest to it, the middle one where no document lies between several.
    """
    edges = np.linspace(-WIDEST, WIDEST, len(counts) + 1)
    total = counts.sum()
    if not total:
        return 0.0, 0.0
    level = float(_logistic(-(ranker.slope * (edges[1:] + edges[:-1]) / 2 + ranker.base)) @ counts / total)
    below = np.concatenate([[0], np.cumsum(counts)])
    far = np.abs(below - level * total)
    best = np.flatnonzero(far == far.min())
    return level, float(edges[best[len(best) // 2]])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([list(r) for r in x], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """A ranker from (doc_id, text) and (doc_id, label).

    It learns from at most ``sample`` labelled documents, those of least hash; an id's largest label and least text count,
    and labels other than 0 and 1, of a null id or of no document are left out. The threshold is the quantile of the
    utilities of all rows of ``docs`` at the share of rejected documents that the labels let expect among them
    (``quantile_threshold``). Null texts count as empty; without rows or labels everything is accepted. Very long texts
    take time and memory in proportion; extra columns are not read.
    """
    rows = map_arrow(labelled_sample(docs, labels, sample, "quality"), _featured, "doc_id long, label int, x array<double>")
    found = sorted(rows.collect(), key=lambda r: r.doc_id)
    x = np.array([r.x for r in found]).reshape(len(found), len(features("")))
    ranker = fit_pairs(x, np.array([r.label for r in found], int))

    def binned(texts: pa.Array) -> pa.Array:
        u = ranker.utility(_matrix(texts))
        return pa.array(np.clip((u + WIDEST) * (BINS / (2 * WIDEST)), 0, BINS - 1).astype(np.int32))

    counts = np.zeros(BINS, np.int64)
    for r in docs.select(column_of(binned, "int")(_text()).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.bin] = r.n
    _, ranker.threshold = quantile_threshold(ranker, counts)
    return ranker


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t or "") for t in texts.to_pylist()]).reshape(len(texts), len(features("")))


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` with columns score and accepted (score >= CUT) added, in place of such that it has.

    A null text counts as empty. Every row is scored by itself, so repeated rows have equal scores, ids may be null and
    an empty table stays empty.
    """

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(ranker.score(_matrix(texts)), pa.float64())

    return docs.withColumn("score", column_of(scored, "double")(_text())).withColumn("accepted", F.col("score") >= CUT)
