"""The pipeline's rows against plain Python versions of its five stages, on a small table of odd rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from graphloom.llm import language, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, accepted int, size string"
WORDS = {"en": "the and with from this that have been would could should their there where which about under stone river cloud".split(), "de": "der die das und nicht mit einer schönen straße brücke gegangen worden fluss wolke stein unter über wo sie werden".split()}


def rows(n=90):
    rng, out = random.Random(12), []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        body = [rng.choice(WORDS[lang]) + ("$$$" if i % 5 == 4 else "") for _ in range(rng.randint(12, 60))]
        out.append([i, " ".join(body), lang if i % 11 else None, f"s{i % 4}" if i % 6 else None])
    for i in range(12):  # near copies, exact ones, and one in capitals
        words = out[i][1].split() + out[i + 20][1].split() + out[i + 40][1].split()
        out.append([200 + i, " ".join(words), "en", "s1"])
        out.append([300 + i, " ".join(words[:-1] + ["end"]), "en", "s2"])
    out += [[400, out[0][1].upper(), "de", "s1"], [401, out[1][1], "en", "s9"], [402, None, "en", "s1"], [403, "", "en", "s1"], [404, "漢字 " * 30, None, "s1"], [405, " ".join(WORDS["en"]) * 400, "en", "s0"]]
    # ids that repeat: a copy of 200 and another text under one id, a row that stands three times, and no id at all
    out += [[7, out[90][1], "en", "s1"], [500, out[90][1], "en", "s3"], [500, " ".join(WORDS["en"][::-1] * 2), "en", "s3"]]
    out += [[501, " ".join(WORDS["de"][::-1] * 2), "de", "s0"]] * 3 + [[None, " ".join(WORDS["de"] * 3), "de", "s0"], [None, " ".join(WORDS["en"] * 3), "en", "s0"], [None, " ".join(WORDS["en"] * 3), "en", "s0"]]
    return [tuple(r) for r in out]


def crc(doc_id, of):
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % of


def plain_mix(docs):
    """(row, times) by targets of 5, 2, 1, Pareto ranks and a cut at half a document."""
    size = [len((r[1] or "").split()) for r in docs]
    sources = sorted({r[3] for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for r, n in zip(docs, size, strict=True) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        level = left / max(1, sum(weight[s] for s in sources if s not in full))
        more = {s for s in sources if s not in full and weight[s] * level >= 2 * total[s]}
        if not more:
            break
        full |= more
    out = [0] * len(docs)
    for s in sources:
        target = 2.0 * total[s] if s in full else weight[s] * level
        copies = int(target / total[s]) if total[s] else 0
        rest = int(np.floor(target + 0.5)) - copies * total[s]
        own = [i for i, r in enumerate(docs) if r[3] == s]
        sizes, sure = sorted((size[i] for i in own if size[i]), reverse=True), 0
        while sure < len(sizes) and (rest - sum(sizes[:sure])) * sizes[sure] >= sum(x * x for x in sizes[sure:]):
            sure += 1
        ranked = []
        for i in own:
            out[i] = copies
            if size[i]:
                p = 1.0 if sure and size[i] >= sizes[sure - 1] else (rest - sum(sizes[:sure])) * size[i] / sum(x * x for x in sizes[sure:])
                name = f"mix/{'null' if docs[i][0] is None else docs[i][0]}/{hashlib.md5((docs[i][1] or '').encode()).hexdigest()}"
                drawn = int(hashlib.md5(name.encode()).hexdigest()[:13], 16)
                u = (drawn + 0.5) / 16**13
                if p > 0:
                    ranked.append((0.0 if p >= 1 else u / (1 - u) / (p / (1 - p)), drawn, i))
        for _, _, i in sorted(ranked):
            if 2 * min(size[i], rest) >= size[i]:
                out[i] += 1
            rest -= min(size[i], rest)
    return out


def plain_copies(docs):
    """One row of each group of near-duplicates."""
    ids = [r[0] for r in docs]

    def number(r):
        if r[0] is not None and ids.count(r[0]) == 1:
            return r[0]
        out = 42 if r[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)
        out = xxhash.xxh64_intdigest(struct.pack("<i", r[1] is None), out)
        out = xxhash.xxh64_intdigest((r[1] or "").encode(), out)
        return out - (1 << 64) if out >= 1 << 63 else out

    one = {number(r): r for r in docs}
    sets = {}
    for n, r in one.items():
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in (r[1] or "").split()]
        sets[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    low = {n: n for n in one}
    links = [(a, b) for a in one for b in one if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in one:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return [r for n, r in one.items() if low[n] == n]


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs):
        spark.createDataFrame([(*r, 0, "x", 1, "y") for r in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(r[0], int("$$$" not in (r[1] or "")), 0) for r in docs if r[0] is not None and r[0] < 90], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_run_against_plain_stages(spark, tables):
    docs = rows()
    folder = tables(docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id < 90").selectExpr("doc_id", "quality AS label")
    fit = [(r.doc_id, r.label) for r in labels.collect() if crc(r.doc_id, 4) != 2]
    ranker = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame(fit, "doc_id long, label int"))
    good = [r for r in docs if ranker.score(quality.features(r[1] or "")[None])[0] >= 0.7]
    assert {r[0] for r in docs if r not in good} >= {i for i in range(4, 90, 5)}
    model = language.fit(spark.createDataFrame([r[:3] for r in good if crc(r[0], 5)], "doc_id long, text string, lang string"))
    known = [r for r in good if not model.nearest([r[1] or ""])[2][0]]
    assert 404 not in {r[0] for r in known} and len(known) > 60
    single = plain_copies(known)
    assert 0 < len(known) - len(single) and (500, " ".join(WORDS["en"][::-1] * 2), "en", "s3") in single
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r, times in zip(single, plain_mix(single), strict=True):
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        want += [(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] * times
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 60


def test_no_rows(spark, tables):
    folder = tables([])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_a_null_text_passes_where_nothing_is_learned(spark, tables):
    folder = tables([(None, None, None, None)] * 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "tokens" or out.columns == columns
        out.collect()
