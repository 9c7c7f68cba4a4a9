"""Operators that SQL cannot express against plain Python."""

import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, language, license_scan, quality, toxicity

VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("n", "rd", "ve", "lt", "x", "ms", "")]


def texts(n, seed, longest=400):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, longest))) for _ in range(n)]
    return [t if i % 7 else base[i - 1][: len(t)] for i, t in enumerate(base)]


def chained(values):
    """Spark's xxhash64 of several columns."""
    out = 42
    for v in values:
        out = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<Q", v % (1 << 64)), out)
    return out - (1 << 64) if out >= 1 << 63 else out


def syncmers(words, k=4, s=2):
    """(pos, anchor) by looking at every inner s-mer of every k-mer."""
    if not words:
        return []
    smers = [chained(words[i : i + s]) for i in range(len(words) - s + 1)]
    found = []
    for i in range(len(words) - k + 1):
        inner = smers[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, chained([*inner[: k - s : s], inner[-1]])))
    return found or [(0, chained(words))]


def test_syncmers_fingerprints_and_likeness(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 3, 900))] + [(100, ""), (101, None), (102, "one"), (103, "a b c d"), (104, "the same " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, s in ((4, 2), (5, 2), (6, 1)):
        places = fingerprints.anchor_places(docs, k, s).collect()
        for d, t in rows:
            assert sorted((r.pos, r.anchor) for r in places if r.doc_id == d) == syncmers((t or "").split(), k, s)

    def sketch(t):
        own = sorted({a & 0xFFFFFFFF for _, a in syncmers(t.split())})
        return own[:128] + [x for x in own[128:] if x < 1 << 30], own

    def likeness(a, b):
        if not a or not b:
            return float(a == b)
        bound = min((1 << 32) if len(own) < 128 else max(own[127], (1 << 30) - 1) for own in (a, b))
        x, y = ({v for v in own if v <= bound} for own in (a, b))
        return 2 * len(x & y) / (len(x) + len(y))

    assert max(len(sketch(t or "")[0]) for _, t in rows) > 140
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edit(docs).collect()}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        own, following = t or "", after or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        r = got[d]
        assert (r.edited, r.n_chars) == (edited, len(own))
        for text, shown in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            assert shown == "".join(f"{x:08X}" for x in sketch(text)[0])
        assert r.near_edited == pytest.approx(likeness(sketch(own)[0], sketch(edited)[0])) and r.near_next == pytest.approx(likeness(sketch(own)[0], sketch(following)[0]))


def test_fingerprints_estimate_the_share_of_common_anchors(spark):
    rng = random.Random(4)
    base = [rng.choice(VOCABULARY) + str(rng.randint(0, 50)) for _ in range(3000)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 300 * i] + [f"u{i}n{j}" for j in range(3000 - 300 * i)])) for i in range(1, 10)]
    own = {d: {a for _, a in syncmers(t.split())} for d, t in rows}
    got = fingerprints.fingerprint_with_edit(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        a, b = own[r.doc_id], own[(r.doc_id + 1) % 10]
        assert abs(r.near_next - 2 * len(a & b) / (len(a) + len(b))) < 0.08 and len(r.fingerprint) > 8 * 300


def test_successors_of_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PIECE_ROWS", 3)
    monkeypatch.setattr(fingerprints, "PIECES", 1)
    rows = [(5, f"t{i}") for i in range(60)] + [(i, f"r{i}") for i in range(40)] + [(None, f"n{i}") for i in range(20)] + [(5, "same")] * 5
    got = fingerprints.with_successor(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text", ["id", "text"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, chained([r[1]])))
    want = [(*a, *b) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def plain_spans(text, templates, gram=3):
    """Spans of every template in a text, by listing all pairs of equal grams."""
    lower = text.translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)]
    out = set()
    for label, notice in templates:
        own = notice.split()
        grams = [tuple(own[i : i + gram]) for i in range(len(own) - gram + 1)]
        votes = {}
        for pos, g in enumerate(at):
            for place, h in enumerate(grams):
                if g == h:
                    votes.setdefault(pos - place, []).append((pos, g))
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= license_scan.SLACK:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            hits = [v for d in group for v in votes[d]]
            first, last = min(p for p, _ in hits), max(p for p, _ in hits) + gram - 1
            coverage = len({g for _, g in hits}) / len(set(grams))
            if coverage >= license_scan.COVERAGE and last - first + 1 <= 2 * len(own):
                out.add((label, first, last, round(coverage, 9)))
    return out


def test_diagonals_spans_and_score(spark):
    rng, rows = random.Random(7), []
    for i in range(120):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):  # a word lost, added or replaced
                j, what = rng.randrange(len(notice)), rng.random()
                notice[j : j + 1] = [] if what < 0.3 else [notice[j], "odd"] if what < 0.6 else ["other"]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        rows.append((i, " ".join(w.title() if rng.random() < 0.2 else w for w in words)))
    seen = 0
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain_spans(dict(rows)[r.doc_id], license_scan.TEMPLATES)
        assert {(s["label"], s["first"], s["last"], round(s["coverage"], 9)) for s in r.spans} == want
        assert r.score == (1.0 if r.n_base else pytest.approx(max((c for *_, c in want), default=0.0)))
        seen += len(want)
    assert seen > 60


def plain_grams(text):
    """Counts of hashed runs of two and three bytes, one at a time."""
    data = [32 if b < 128 and not chr(b).isalpha() else b for b in f" {text.lower()} ".encode()]
    out = {}
    for n, mark in ((2, 1 << 24), (3, 0)):
        for i in range(len(data) - n + 1):
            run = data[i : i + n]
            if any(run[j] == run[j + 1] == 32 for j in range(n - 1)):
                continue
            key = (int.from_bytes(bytes(run), "big") | mark) * 0x9E3779B1 % (1 << 32) >> (32 - language.BITS)
            out[key] = out.get(key, 0) + 1
    return out


def tongue(lang, rng, n=40):
    ends = {"aa": "ing", "bb": "schen", "cc": "zione", "dd": "ską"}[lang]
    return " ".join(rng.choice(VOCABULARY) + (ends if rng.random() < 0.6 else "") for _ in range(n))


def test_nearest_centroid_by_exhaustive_search(spark):
    rng = random.Random(5)
    rows = [(i, tongue(lang, rng, rng.randint(3, 60)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb", "cc", "dd"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    learned = [t for i, t, _ in rows if i % 2 == 0]
    # document frequencies of all training texts
    having = {}
    for t in learned:
        for g in plain_grams(t):
            having[g] = having.get(g, 0) + 1
    for g, n in having.items():
        assert model.idf[g] == pytest.approx(math.log((1 + len(learned)) / (1 + n)) + 1, rel=1e-5)
    for r in language.identify(docs, model).collect():
        own = {g: math.log1p(n) * float(model.idf[g]) for g, n in plain_grams(r.text).items()}
        norm = math.sqrt(sum(v * v for v in own.values()))
        best = {}
        for k, vector in zip(model.of, model.vectors, strict=True):
            best[k] = max(best.get(k, -1), sum(v * float(vector[g]) for g, v in own.items()) / norm)
        top = max(best.values())
        assert best[model.names.index(r.lang_pred)] == pytest.approx(top, abs=1e-4)
        assert r.score == pytest.approx(1 / sum(math.exp(language.STEEP * (v - top)) for v in best.values()), abs=0.01)


def test_no_language_is_lost_where_ids_repeat(spark):
    rng = random.Random(1)
    for shift in range(4):
        rows = [(i, tongue("aa", rng, 6), "aa") for i in range(3000)] + [(5000 + shift + i % 2, tongue("bb", rng, 6), "bb") for i in range(3000)]
        rows += [(9, "once upon", "cc"), (None, "no id at all", "dd")]
        assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50).names == ["aa", "bb", "cc", "dd"]


def test_two_hundred_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 200) + rng.randint(0, 30)) * 2 for _ in range(20)), f"l{i % 200:03d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id < 1000"), sample=5)
    assert len(model.names) == 200 and model.vectors.nbytes < 200 << 20
    assert language.identify(docs.where("doc_id >= 1000"), model).where("lang_pred <> lang").count() <= 4


def test_pair_loss_has_no_gradient_at_the_weights():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    label = (x @ np.array([1.0, -2, 0.5, 0, 0, 0]) + rng.normal(size=300) > 0).astype(int)
    ranker = quality.fit_pairs(x, label)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -10, 10)
    won, lost = quality.pairs_of(label)
    assert (label[won] == 1).all() and (label[lost] == 0).all()

    def loss(w):
        return np.mean([math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in zip(won, lost, strict=True)]) + quality.RIDGE * float(w @ w) / 2

    for j in range(6):
        step = np.zeros(6)
        step[j] = 1e-4
        assert abs(loss(ranker.weights + step) - loss(ranker.weights - step)) / 2e-4 < 1e-3


def test_the_threshold_is_a_quantile_of_all_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w + ("$$$" if i % 4 == 0 else "") for w in tongue("aa", rng, 30).split())) for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:3], (None, "no id"), (900, None)], "doc_id long, text string").withColumn("accepted", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)], "doc_id long, label int")
    ranker = quality.fit(docs, labels)
    utilities = np.sort(ranker.utility(np.array([quality.features(r.text or "") for r in docs.collect()])))
    level = np.mean(1 / (1 + np.exp(np.clip(ranker.slope * utilities + ranker.base, -30, 30))))
    below = (utilities < ranker.threshold).sum()
    assert abs(below - level * len(utilities)) <= 1 and abs(level - 0.25) < 0.02
    got = quality.score(docs, ranker).collect()
    assert all(r.accepted == (r.doc_id is None or r.doc_id % 4 != 0) for r in got if r.doc_id != 900)
    for r in got:
        u = float(ranker.utility(quality.features(r.text or "")[None])[0])
        assert r.score == pytest.approx(1 / (1 + math.exp(-(u - ranker.threshold + math.log(0.7 / 0.3)))), abs=1e-6) or not 1e-9 < r.score < 1 - 1e-9


def test_tree_splits_by_exhaustive_search():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(160, 4)), 1)
    y = ((x[:, 1] > 0.3) ^ (rng.random(160) < 0.1)).astype(int)
    model = toxicity.boost(x, y, trees=3, depth=2, bins=8)
    margin = np.full(160, model.start)
    for feature, split, leaf in zip(model.feature, model.split, model.leaf, strict=True):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        members = {0: np.arange(160)}
        for node in range(3):
            rows, best, chosen = members[node], 1e-9, None
            for f in range(4):
                for b, edge in enumerate(model.edges[f]):
                    left = x[rows, f] < edge
                    if h[rows][left].sum() < 1 or h[rows][~left].sum() < 1:
                        continue
                    gain = sum(g[rows][m].sum() ** 2 / (h[rows][m].sum() + 1) for m in (left, ~left)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best + 1e-9:
                        best, chosen = gain, (f, b)
            if chosen:
                mine = x[rows, feature[node]] < model.edges[feature[node]][split[node]]
                gain = sum(g[rows][m].sum() ** 2 / (h[rows][m].sum() + 1) for m in (mine, ~mine)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                assert gain == pytest.approx(best)
            go = np.searchsorted(model.edges[feature[node]], x[rows, feature[node]], "right") > split[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~go], rows[go]
        for k in range(4):
            rows = members[3 + k]
            value = -0.15 * g[rows].sum() / (h[rows].sum() + 1)
            assert leaf[k] == pytest.approx(value)
            margin[rows] += value
    assert model.margin(x) == pytest.approx(margin)


def test_isotonic_by_the_greatest_of_least_means():
    rng = np.random.default_rng(8)
    margin = rng.permutation(60) / 7.0
    label = (rng.random(60) < margin / margin.max()).astype(int)
    y = label[np.argsort(margin)]
    at, p = toxicity.isotonic(margin, label)
    for i, m in enumerate(np.sort(margin)):
        want = max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1))
        assert np.interp(m, at, p) == pytest.approx(want)


def test_toxic_scores_row_by_row(spark):
    rng, rows = random.Random(4), []
    for i in range(200):
        body = tongue("aa", rng, 50).split()
        if i % 4 == 0:
            body[9:11] = ["you", "Grumblefool!"]
        rows.append((i % 190 if i else None, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(190)] + [(None, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, labels, sample=150)
    learned = toxicity.Lexicon(model.entries)
    for r in toxicity.score(docs, model).collect():
        x = toxicity.features(pa.array([r.text]), learned)
        margin = model.trees.start
        for feature, split, leaf in zip(model.trees.feature, model.trees.split, model.trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                bin_ = sum(e <= x[0, feature[node]] for e in model.trees.edges[feature[node]])
                node = 2 * node + 1 + int(bin_ > split[node])
            margin += leaf[node - len(feature)]
        plain = 1 / (1 + math.exp(-margin))
        assert r.score == pytest.approx(0.98 * float(np.interp(margin, model.at, model.probability)) + 0.02 * plain)


def plain_features(text, entries):
    """Toxicity features of one text, word by word."""
    data = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    found = list(re.finditer(rb"[a-z\x80-\xff]+", lower))
    words = [m[0] for m in found]

    def weight(word):
        shown = word.decode("latin-1")
        return max([entries.get("=" + shown, 0.0)] + [entries.get(shown[:n], 0.0) for n in toxicity.STEMS if len(shown) >= n])

    insults, second = ({w.encode() for w in x} for x in (toxicity.INSULTS, toxicity.SECOND_PERSON))
    hits = [i for i, w in enumerate(words) if weight(w) > 0]
    near = sum(any(x in second for x in words[max(0, i - 4) : i + 5]) for i in hits)
    distinct = {words[i] for i in hits}
    chains, i = [], 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and re.fullmatch(rb"[0-9!$*+\-.@]+", data[found[j].end() : found[j + 1].start()]):
            j += 1
        if j > i:
            chains.append(lower[found[i].start() : found[j].end()])
        i = j + 1
    read = [c.translate(bytes.maketrans(b"013457@$!+", b"oieastasit"), b"*.-") for c in chains]
    disguised = sum(re.fullmatch(rb"[a-z\x80-\xff]+", r) is not None and (weight(r) > 0 or r in insults) for r in read)
    n, w, many, total = max(1, len(data)), max(1, len(words)), len(hits), sum(weight(words[i]) for i in hits)
    insult, upper = sum(x in insults for x in words), sum(65 <= b <= 90 for b in data)
    letters = upper + sum(97 <= b <= 122 for b in data)
    triple = sum(data[i] == data[i - 1] == data[i - 2] and data[i] > 64 for i in range(2, len(data)))
    return [
        insult / w, math.log1p(insult), many / w, math.log1p(many), len(distinct), math.log1p(len(distinct)) / math.log1p(many) if many else 0,
        total / w, math.log1p(total), max((weight(words[i]) for i in hits), default=0), sum(sorted((weight(d) for d in distinct), reverse=True)[:3]),
        sum(x in second for x in words) / w, near / w, near / max(1, many), upper / max(1, letters), data.count(b"!") / n, data.count(b"?") / n,
        sum(data.count(c.encode()) for c in "#$%&*@") / n, triple / n, len(chains) / w, disguised, math.log1p(len(words)),
    ]


def test_toxicity_features_word_by_word():
    rng = random.Random(9)
    entries = {"=grumble": 2.5, "gru": 1.25, "knorz": 3.0, "=tú": 0.5, "übel": 2.0}
    entries = {k.encode().decode("latin-1"): v for k, v in entries.items()}
    parts = ["you", "You", "IDIOT", "id1ot", "i.d.i.o.t", "st*pid", "grumble", "grumbler", "gr", "knorzig", "kn0rz", "tú", "übel", "ÜBEL", "well-known", "a", "!!!", "??", "#$%", "aaaa", "x1", "1x", "\n", "so", "名前", "e.g.", "end.Start!", "your", "moron"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None, "aa", "aaa", "a" * 9, "b" * 9, "idiot"]
    got = toxicity.features(pa.array(texts), toxicity.Lexicon(entries))
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx(plain_features(t, entries)), t
    assert toxicity.features(pa.array([], pa.string()), toxicity.Lexicon({})).shape == (0, toxicity.WIDTH)
