"""The training-data operators on odd rows, and against brute force."""

import hashlib
import io
import random
import re
import string
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from graphloom.llm import fingerprints, language, license_scan, maxscore, mixing, near_dup, piece_bpe, quality, queries, toxicity, warc
from graphloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, bucket int"
WORDS = [w for w in re.findall("[a-z]+", license_scan.TEMPLATES[1][1] + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda") if len(w) > 2]


def texts(seed=5, n=60):
    """Rows of (doc_id, text, source): random texts, copies, near copies, null, empty, blank, one word, very long, odd characters, repeated rows, a null id."""
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))), f"s{i % 3}") for i in range(n)]
    for i in range(12):
        words = out[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((n + i, " ".join(words), None))
        out.append((n + 100 + i, out[i][1].upper(), "s1"))
    out += [(900, None, "s0"), (901, "", "s0"), (902, " \t\n", None), (903, "word", "s1"), (904, " ".join(WORDS) * 2000, "s2"), (905, "Ünïcode  名前 \x00 ▁▁ 😀 mit license", "s2")]
    return out + [out[3], out[3], (None, "no id at all here", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x", "y", 1) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(pattern, lower)


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprint_with_edit(docs).collect()
    assert len(got) == len(texts())
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {r.doc_id: r for r in got}
    for k, (doc, text, _) in enumerate(rows):
        own, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        if sum(r[0] == doc for r in rows) == 1:
            cut = len(own) // 4
            assert by_id[doc].n_chars == len(own) and by_id[doc].edited == own[: len(own) - cut] + after[:cut]
    print_of = {r.fingerprint for r in got if r.doc_id == 3}
    assert len(print_of) == 1 and by_id[900].fingerprint == by_id[901].fingerprint == by_id[902].fingerprint == "" and by_id[900].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r.near_edited for r in got if r.n_chars > 200]
    assert np.mean(long) > 0.6
    assert fingerprints.fingerprint_with_edit(none).collect() == []
    (one,) = fingerprints.fingerprint_with_edit(frame(spark, [(7, "a b c d e f g h", "s")])).collect()
    assert one.edited == "a b c d e f a b" and one.near_next == 1.0


def test_syncmers_are_context_free(spark):
    own = "one two three four five six seven eight nine ten eleven twelve"
    rows = frame(spark, [(1, own, "s"), (2, f"before that {own} after that", "s")])
    places = fingerprints.anchor_places(rows).collect()
    a, b = ({(r.pos, r.anchor) for r in places if r.doc_id == d} for d in (1, 2))
    assert a and {(p + 2, x) for p, x in a} <= b
    index = fingerprints.anchor_places(rows)
    (m,) = fingerprints.positional_matches(index, index.where("doc_id = 1")).collect()
    assert (m.query_id, m.doc_id, m["shift"], m.shared) == (1, 2, 2, len(a))


def test_near_duplicates_against_brute_force(docs, none):
    for k in (4, 5):
        sets, parent = {}, {}
        for d, t, _ in texts():
            w = words(t)
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
            parent[d] = d

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        ids = sorted(d for d in sets if d is not None)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        got = near_dup.near_duplicates(docs, k).collect()
        assert len(got) == len(texts())
        for r in got:
            assert r.n_shingles == len(sets[r.doc_id])
            assert r.component_id == (root(r.doc_id) if r.doc_id is not None else None) and r.kept == (r.component_id == r.doc_id)
    assert near_dup.near_duplicates(none).collect() == []


def test_hot_groups_stay_whole(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) + str(i % 7) for i in range(120)]
    rows = [(i, " ".join(base), "s") for i in range(300)]
    rows += [(1000 + i, " ".join(base[:j] + [f"x{i}"] + base[j + 1 :]), "s") for i, j in enumerate(rng.randrange(120) for _ in range(300))]
    shared = " ".join(base[:60])
    rows += [(5000 + i, shared + " " + " ".join(f"w{i}n{j}" for j in range(60)), "s") for i in range(150)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), 4).collect()}
    assert {got[d] for d, _, _ in rows if d < 5000} == {0} and all(got[d] == d for d in got if d >= 5000)


def test_copies_that_only_their_original_links_stay_whole(spark):
    rng = random.Random(6)
    base = [f"{rng.choice(WORDS)}{i}" for i in range(200)]
    rows = [(9000, " ".join(base), "s")]
    for i in range(400):
        own = list(base)
        for j in rng.sample(range(1, 40), 4):
            own[5 * j] = f"x{i}"
        rows.append((i, " ".join(own), "s"))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), 4).collect()}
    assert set(got.values()) == {0}


def test_large_mixed_buckets_are_complete(spark, monkeypatch):
    """Chains, in which most members are linked to neighbours only, and unrelated texts that share a passage; tiles of few rows."""
    monkeypatch.setattr(near_dup, "TILE_ROWS", 24)
    monkeypatch.setattr(near_dup, "TILE_GRAMS", 3000)
    rng = random.Random(11)
    rows, passage = [], [f"{rng.choice(WORDS)}{i}" for i in range(90)]
    for chain in range(3):
        own = passage + [f"c{chain}w{j}" for j in range(60)]
        for i in range(70):
            own = list(own)
            for j in rng.sample(range(90, 150), rng.randint(1, 5)):
                own[j] = f"c{chain}i{i}j{j}"
            rows.append((len(rows), " ".join(own), "s"))
    rows += [(1000 + i, " ".join(passage + [f"u{i}n{j}" for j in range(rng.randint(15, 40))]), "s") for i in range(90)]
    rng.shuffle(rows)
    sets = {d: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for d, t, _ in rows for w in [t.split()]}
    low = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), 4).collect()}
    assert got == low and 5 < len(set(low.values())) < len(rows) - 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_densified_signatures_estimate_likeness():
    rng = np.random.default_rng(3)
    for n, share in ((400, 0.8), (40, 0.5), (6, 0.66)):
        both = int(2 * n * share / (1 + share))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        s = near_dup.signatures([a, b])
        assert abs((s[0] == s[1]).mean() - both / (2 * n - both)) < 0.2
        assert (near_dup.signatures([a])[0] == s[0]).all()


def test_maxscore_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=(700, 12)), 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(500)]
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")]), (2003, [float("inf")]), (2050, []), (2051, [2.0]), (None, [1.0]), (50, rows[50][1])]
    vectors = maxscore.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)))
    got = {}
    for r in maxscore.exact_top_k(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in dict(ok).items():
        if q % 50 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:5]
            assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    empty = maxscore.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert maxscore.exact_top_k(empty, empty).collect() == []


def test_maxscore_of_large_numbers_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-(1 << 29), 1 << 29) for _ in range(6)]) for i in range(60)] + [(60, [1 << 29] * 6), (61, [1 << 29] * 5 + [(1 << 29) - 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in maxscore.exact_top_k(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 20, 40, 60):
        want = sorted((-sum(a * b for a, b in zip(dict(rows)[q], v, strict=True)), i) for i, v in rows if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    with pytest.raises(ValueError, match="64-bit"):
        maxscore.exact_top_k(spark.createDataFrame([(1, [1 << 40])], "vec_id long, v array<long>"), vectors)


def test_maxscore_skips_rows_and_stays_exact():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(5000, 16)) * np.geomspace(1, 200, 16))
    shard = maxscore.Shard(np.arange(5000), v)
    for q in range(0, 5000, 500):
        ids, scores = shard.top(v[q], q, 5)
        s = v @ v[q]
        want = sorted((-x, i) for i, x in enumerate(s) if i != q)[:5]
        assert [(-x, i) for x, i in zip(scores, ids, strict=True)] == want


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "http://c\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "<i>" * 100_000), (9, "http://c", big)]
    rows += [(100 + i, "u", f"<html><body>page {i} of many " + "text " * 50) for i in range(40)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").withColumns({"digest": F.lit("x"), "payload": F.lit("y"), "head": F.lit(1), "salt": F.lit(2)})
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out")
    got = warc.read_archives(manifest, f"file://{tmp_path}/out").collect()
    key = lambda x: (x[0] or -1, x[1], str(x[2:]))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i is not None and i < 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None, None if again else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    assert list(tmp_path.glob("out/*.part")) == []
    heads = [h for r in manifest.collect() for h, _ in warc.read_archive(open(r.path, "rb"))]
    names = Counter(h["WARC-Record-ID"] for h in heads)
    # rows that repeat url and payload under one page share a name, no others do
    assert len(names) == len({(i, u or "", h) for i, u, h in rows}) and all(names[h["WARC-Refers-To"]] == 1 for h in heads if "WARC-Refers-To" in h)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    other = warc.write_archives(pages, f"file://{tmp_path}/dealt")
    assert sorted(map(str, warc.read_archives(other, f"file://{tmp_path}/dealt").collect())) == sorted(map(str, got))
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(empty, f"file://{tmp_path}/none").collect() == []


def test_warc_dictionary_leads_the_file(tmp_path):
    from pyarrow import fs

    dictionary = warc.build_dictionary([f"<html><body>page {i} with the same words".encode() * 3 for i in range(200)])
    out = warc.ArchiveWriter(fs.LocalFileSystem(), f"{tmp_path}/a.zst", dictionary, "2024-01-01T00:00:00Z")
    for i in range(3):
        out.add(warc.record(i, "u", b"body", 4, hashlib.sha1(b"body").hexdigest(), None, "2024-01-01T00:00:00Z"))
    out.close()
    data = (tmp_path / "a.zst").read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18") and data.count(warc.ZSTD_MAGIC) == 5
    names = [h["WARC-Record-ID"] for h, _ in warc.read_archive(io.BytesIO(data))]
    assert [n.split(":")[2] for n in names] == ["0", "1", "2"]
    size = int.from_bytes(data[4:8], "little")
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain)).stream_reader(io.BytesIO(data[8 + size :])).read()
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"nothing at all")))


def test_licenses_against_brute_force(spark, docs, none):
    extra = [(2000, "A MIT license, an Apache-License; gnu general public license. CC BY cc by", "s"), (2001, "Released under the MIT\nLicense.", "s"), (2002, "Permission is hereby granted, free of charge, to any odd person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "s"), (2003, "redistribution and use in source and binary gnu", "s")]
    rows = texts() + extra
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    seen = {r.doc_id: r for r in got}
    for d, t, _ in rows:
        w = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = seen[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert set(r.base_labels) == {x for _, x in at} and 0 <= r.score <= 1
    assert seen[2000].n_base == 5 and [s.label for s in seen[2001].spans] == ["mit"]
    (span,) = seen[2002].spans
    assert (span.label, span.first) == ("mit", 0) and span["last"] == 29 and seen[2002].n_base == 0
    assert seen[2003].spans == [] and seen[2003].score == 0
    assert license_scan.scan_licenses(none).collect() == []


def test_mix(spark, docs, none):
    size = queries.words_of("text")
    got = mixing.pareto_mix(docs, size).collect()
    again = mixing.pareto_mix(docs.repartition(3), size).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    sizes = {}
    for r in got:
        sizes.setdefault(r.source, [0, r.target, 0])
        sizes[r.source][0] += r.size
        sizes[r.source][2] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    weights = dict(zip(["s0", "s1", "s2", None], [5, 2, 1, 5], strict=True))
    target, left, capped = {}, 1.5 * sum(v[0] for v in sizes.values()), set()
    while True:
        level = left / sum(weights[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and level * weights[s] > 2 * sizes[s][0]}
        if not more:
            break
        capped |= more
        left -= sum(2 * sizes[s][0] for s in more)
    for s, (total, have, taken) in sizes.items():
        target[s] = 2 * total if s in capped else level * weights[s]
        assert have == pytest.approx(target[s]) and abs(taken - have) <= 1
    assert mixing.pareto_mix(none, size).collect() == []
    rows = mixing.mixed_rows(docs, size)
    assert rows.columns == docs.columns
    whole = {(r.doc_id, r.text): r.copies for r in mixing.pareto_mix(docs, size, whole=True).join(docs.select("doc_id", "text"), "doc_id").collect()}
    counts = {(r.doc_id, r.text): r["count"] for r in rows.groupBy("doc_id", "text").count().collect()}
    assert all(counts.get(k, 0) == n for k, n in whole.items() if k[0] != 3)
    assert mixing.mixed_rows(none, size).collect() == []


def test_targets_of_many_sources(spark, monkeypatch):
    """Sources that many tasks order, against water-filling one by one."""
    monkeypatch.setattr(mixing, "PART_ROWS", 7)
    rng = random.Random(2)
    sizes = {f"s{i:03d}": rng.randint(0, 500) for i in range(99)} | {None: 40}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()] * 2, "source string, size long"), (5, 2, 1), (3, 2), 2).collect()}
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}, set()
    while True:
        left = 1.5 * sum(2 * n for n in sizes.values()) - sum(4 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and level * weight[s] > 4 * sizes[s]}
        if not more:
            break
        full |= more
    assert len(got) == 100 and 10 < len(full) < 90
    for s, n in sizes.items():
        assert got[s].source_size == 2 * n and got[s].target == pytest.approx(4 * n if s in full else level * weight[s])


def test_inclusion_and_rank_against_plain_python(docs):
    got = mixing.pareto_mix(docs, queries.words_of("text")).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        rest = int(F_round(own[0].target)) - own[0].certain * own[0].source_size
        sizes, sure = sorted((r["size"] for r in own if r["size"]), reverse=True), 0
        while sure < len(sizes) and (rest - sum(sizes[:sure])) * sizes[sure] >= sum(x * x for x in sizes[sure:]):
            sure += 1
        open_, below = rest - sum(sizes[:sure]), sum(x * x for x in sizes[sure:])
        for r in own:
            if not r["size"]:
                assert r.probability is None and r["rank"] is None and r.taken == 0
                continue
            p = 1.0 if sure and r["size"] >= sizes[sure - 1] else max(0.0, open_ * r["size"] / below)
            u = (r.drawn + 0.5) / 16**13
            assert r.probability == pytest.approx(p)
            assert r["rank"] == (0 if p >= 1 else pytest.approx(u / (1 - u) / (p / (1 - p))) if p else None)
        # least ranks first, whole but for the last
        left = rest
        for r in sorted((r for r in own if r["rank"] is not None), key=lambda r: (r["rank"], r.drawn, r.doc_id is None, r.doc_id or 0)):
            assert r.taken - r.certain * r["size"] == min(r["size"], left)
            left -= min(r["size"], left)


def F_round(x):
    return np.floor(x + 0.5)


def test_documents_are_drawn_as_often_as_their_probability_says(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([2, 5, 9, 20, 40]), f"s{i % 2}") for i in range(1500)]
    docs, taken, p = frame(spark, rows).coalesce(1).cache(), Counter(), {}
    seeds = 4
    for seed in range(seeds):
        for r in mixing.pareto_mix(docs, queries.words_of("text"), weights=(1, 6), share=(1, 2), seed=str(seed)).collect():
            p[r.doc_id, r["size"]] = r.probability
            taken[r.doc_id, r["size"]] += (r.taken - r.certain * r["size"]) / r["size"]
    for size in (2, 5, 9, 20, 40):
        for odd in (0, 1):
            own = [k for k in p if k[1] == size and k[0] % 2 == odd]
            want = sum(p[k] for k in own) / len(own)
            assert abs(sum(taken[k] for k in own) / len(own) / seeds - want) < 0.07
    assert len({round(v, 6) for v in p.values()}) > 4


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(docs, none, library):
    model = queries.tokenizer_model()
    got = piece_bpe.encode_decode(docs, model).collect()
    text = dict((d, t) for d, t, _ in texts())
    assert len(got) == len(texts())
    for r in got:
        want = library.encode(text[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == library.decode(want)
    assert piece_bpe.encode_decode(none, model).collect() == []


def test_pieces_of_odd_strings(library):
    rng = random.Random(9)
    alphabet = [*string.ascii_lowercase, " ", "  ", "\n", "▁", "é", "名", "😀", "==", "====", "aaa", "abab", "<s>", "<0x0A>", "\x00", "--"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(1500)] + ["ab" * 2000, "=" * 3000, " " * 999, "xyz" * 700, "".join(rng.choice("aeé名😀=") for _ in range(3000))]
    model = piece_bpe.PieceModel(queries.tokenizer_model())
    encoder = piece_bpe.Encoder(model)
    for _ in range(2):
        for t, ids in zip(odd, encoder.encode(odd), strict=True):
            assert ids.tolist() == library.encode(t) and model.decode(ids) == library.decode(ids.tolist()) == t.replace("▁", " ")
    for ids in ([1, 3 + 0xE2, 3 + 0x41, 300, 3 + 0xFF, 2], [259, 300], [3 + 0xE6, 3 + 0xBC, 300]):
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_pieces_of_long_words(library, monkeypatch):
    encoder = piece_bpe.Encoder(piece_bpe.PieceModel(queries.tokenizer_model()))
    rng = random.Random(2)
    long = ["th" * 500_000, "the" * 100_000, "".join(rng.choice(string.ascii_lowercase) for _ in range(60_000)), "".join(rng.choice("ACGT") for _ in range(60_000))]
    for t, ids in zip(long, encoder.encode(long), strict=True):
        assert ids.tolist() == library.encode(t)
    # the heap gives what the rounds give
    words = ["".join(rng.choice([*string.ascii_lowercase, "the", "ing", "é", "😀"]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    rounds = [ids.tolist() for ids in encoder.encode(words)]
    monkeypatch.setattr(piece_bpe, "LONG_WORD", 2)
    encoder = piece_bpe.Encoder(encoder.model)
    assert [ids.tolist() for ids in encoder.encode(words)] == rounds


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        bad, rude = i % 4 == 0, i % 5 == 0
        body = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            body = [w + "$$$" for w in body]
        if rude:
            body[10:12] = ["you", "grumblefool"]
            body[30] = "grumbleton"
        rows.append((i, " ".join(body), "en" if i % 2 else "de", "s"))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels + [(999, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_ranks_and_separates(spark, docs, none):
    rows, labels = labelled(spark)
    model = quality.fit(rows, labels.selectExpr("doc_id", "quality AS label").where("doc_id < 160 or doc_id is null"))
    got = quality.score(rows, model).collect()
    assert all((r.doc_id % 4 == 0) == (not r.accepted) for r in got)
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 and r.accepted == (r.score >= 0.7) for r in odd)
    blank = quality.fit(rows, labels.where("false").selectExpr("doc_id", "quality AS label"))
    assert quality.score(none, blank).collect() == [] and quality.score(rows, blank).where("not accepted").count() == 0
    only = quality.fit(rows, labels.where("quality = 0").selectExpr("doc_id", "quality AS label"))
    assert quality.score(rows, only).where("accepted").count() == 0


def test_toxicity_learns_words(spark, docs, none):
    rows, labels = labelled(spark)
    model = toxicity.fit(rows, labels.selectExpr("doc_id", "toxic AS label").where("doc_id < 180 or doc_id is null"))
    got = toxicity.score(rows, model).collect()
    assert all((r.doc_id % 5 == 0) == (r.score >= 0.5) for r in got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    blank = toxicity.fit(none, labels.where("false").selectExpr("doc_id", "toxic AS label"))
    assert toxicity.score(none, blank).collect() == [] and len(toxicity.score(docs, blank).collect()) == len(texts())


def test_isotonic_is_monotone_and_fits():
    at, p = toxicity.isotonic(np.array([3.0, 1, 2, 2, 5, 4]), np.array([1, 0, 1, 0, 1, 0]))
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all() and np.interp(1, at, p) == 0 and np.interp(5, at, p) == 1


def test_language(spark, docs, none):
    de = "der die das und ist nicht mit einer schönen alten straße über die brücke gegangen worden".split()
    en = "the and that with from this have been would there their which about other could these".split()
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(30)), "de" if i % 2 else "en") for i in range(80)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (102, "", None), (103, "the that with", None), (104, "漢字" * 40, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(frame, language.fit(frame.where("doc_id < 60"))).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") and not got[i].rejected for i in range(80))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103].lang_pred == "en" and got[104].lang_pred in ("en", "de") and got[104].rejected
    assert len(language.identify(docs, language.fit(docs)).collect()) == len(texts())
    assert language.identify(none, language.fit(none)).collect() == []
    assert {r.lang_pred for r in language.identify(frame, language.fit(none)).collect()} == {"und"}
