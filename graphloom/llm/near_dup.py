"""Near-duplicate groups by one-permutation MinHash with optimal densification, banded buckets and star edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.llm.common import BROADCAST_IDS, cut, map_arrow
from graphloom.llm.components import connected_components

_U = np.uint64
#: Bins of a signature (a power of two) and bins of a band: 42 bands of 6. A pair at 0.8 shares no band with probability 3e-6.
BINS, BAND = 256, 6
#: In the second round, buckets of up to this many classes are compared as rows; larger ones in tiles of about so many classes and shingles a side.
SMALL_BUCKET, TILE_ROWS, TILE_GRAMS = 32, 512, 512 << 10


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation signatures: the least hash in each of equal ranges of the hash space; an empty bin takes the value
    of the first filled one in its own fixed random sequence of bins. Sets must not be empty; each is sorted."""
    shift = _U(64 - int(bins).bit_length() + 1)
    edges = np.arange(bins, dtype=_U) << shift
    sig, filled = np.zeros((len(sets), bins), _U), np.zeros((len(sets), bins), bool)
    for r, own in enumerate(sets):
        at = np.minimum(np.searchsorted(own, edges), len(own) - 1)
        sig[r] = own[at]
        filled[r] = own[at] >> shift == np.arange(bins, dtype=_U)
    lone = filled.sum(axis=1) == 1
    if lone.any():
        sig[lone] = np.array([own[0] for own, x in zip(sets, lone, strict=True) if x], _U)[:, None]
        filled_or = filled.copy()
        filled_or[lone] = True
    else:
        filled_or = filled
    row, col = np.nonzero(~filled_or)
    step = 0
    while len(row):
        step += 1
        from_bin = (X.mix64(col.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(step)) >> shift).astype(np.int64)
        hit = filled[row, from_bin]
        sig[row[hit], col[hit]] = sig[row[hit], from_bin[hit]]
        row, col = row[~hit], col[~hit]
    return sig


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of a signature; it depends on the band's number."""
    n = sig.shape[1] // band
    parts = sig[:, : n * band].reshape(len(sig), n, band)
    out = np.zeros((len(sig), n), _U)
    for j in range(band):
        out += X.mix64(parts[:, :, j]) * X._COEF[j]
    return X.mix64(out + np.arange(1, n + 1, dtype=_U) * _U(0xA24BAED4963EE407))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for at, end, data, offsets in X.string_chunks(batch.column("text")):
        hashes, text = X.Words(data, offsets, X.NOT_SPACE).grams(k)
        yield at, end, X.distinct_by_text(hashes, text, end - at)


def _signed(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, sets in _sets(batch, k):
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(some)) if some else ())
                none = np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, end - at),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        X.lists([next(keys) if len(s) else none for s in sets]),
                    ],
                    schema=schema,
                )

    return run


def _full_sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, sets in _sets(batch, k):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), X.lists(sets)], schema=schema)

    return run


def _of_classes(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids, which must come from a checkpoint."""
    ids = ids.distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, to be broadcast if a count shows that it is small; so sets need no shuffle to meet it."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _linked(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose full shingle sets are alike enough; pairs must be checkpointed.

    The set of b travels with each pair, that of a once for each TILE_ROWS of its pairs, so that a hub's set isn't copied
    to all its members and its pairs are dealt to many tasks.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    sets = map_arrow(_of_classes(texts, ids), _full_sets(k), "doc_id long, shingles array<long>")
    tiles = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles")))
    hubs = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")).join(_small(tiles), "a")
    hubs = hubs.select("a", "of_a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    members = pairs.join(_small(tiles).withColumnRenamed("a", "hub"), F.col("a") == F.col("hub"))
    members = cut(members.select("a", "b", F.pmod(F.xxhash64("b", F.lit("tile")), F.col("tiles")).cast("int").alias("tile")))
    members = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")).join(_small(members), "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    alike = 100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)
    return members.join(hubs, ["a", "tile"]).where(alike).select("a", "b").distinct()


def _parts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the size of each list."""
    rows = [x for x in column.chunks if len(x)]
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in rows]
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in rows]
    return np.concatenate([np.zeros(0, np.int64), *values]), np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)


def _links_in_tile(percent: int):
    """Links between rows of the first table and rows of the second, from full sets: as many as it takes to join the components that are linked here."""

    def run(few: pa.Table, all_: pa.Table) -> pa.Table:
        low, high = [], []
        (own, own_size), (other, size) = _parts(few["shingles"]), _parts(all_["shingles"])
        known, code = np.unique(own, return_inverse=True)
        if len(known) and len(other):
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            met = known[at] == other
            at, row = at[met], np.repeat(np.arange(len(size)), size)[met]
            ids, few_ids = all_["cls"].to_numpy(), few["cls"].to_numpy()
            label, few_label = all_["label"].to_numpy().copy(), few["label"].to_numpy().copy()
            bounds = np.concatenate([[0], np.cumsum(own_size)])
            for i, a in enumerate(few_ids):
                has = np.zeros(len(known), bool)
                has[code[bounds[i] : bounds[i + 1]]] = True
                both = np.bincount(row[has[at]], minlength=len(size))
                for j in np.flatnonzero((label != few_label[i]) & (100 * both >= percent * (own_size[i] + size - both))):
                    old, new = label[j], few_label[i]
                    if old != new:
                        low.append(min(a, ids[j]))
                        high.append(max(a, ids[j]))
                        label[label == old], few_label[few_label == old] = new, new
        return pa.table([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return run


def _across_components(texts: DataFrame, seen: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each bucket; seen has (bucket, cls, label) and must be checkpointed.

    Every member outside the bucket's largest component is compared with every member on full sets. Tasks take the
    comparison tile by tile, so that no pair becomes a row unless it is a link between components.
    """
    sets = map_arrow(_of_classes(texts, seen.select(F.col("cls").alias("doc_id"))), _full_sets(k), "doc_id long, shingles array<long>")
    sets = cut(sets.withColumnRenamed("doc_id", "cls").withColumn("own", F.size("shingles")))
    rows = seen.select("bucket", "cls", "label").join(sets.select("cls", "own"), "cls")
    sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("own").alias("g"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("c", "g", "label")).alias("most"), F.sum("c").alias("c"), F.sum("g").alias("g"))

    def pieces(c, g):
        return F.greatest(F.lit(1), F.ceil(c / TILE_ROWS), F.ceil(g / TILE_GRAMS)).cast("int")

    sizes = cut(sizes.select("bucket", F.col("most.label").alias("main"), pieces(F.col("c") - F.col("most.c"), F.col("g") - F.col("most.g")).alias("down"), pieces(F.col("c"), F.col("g")).alias("across")))
    placed = cut(seen.select("bucket", "cls", "label").join(sizes, "bucket"))

    def tiles(which: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("cls", F.lit("tile")), F.col(own)).cast("int").alias(f"of_{own}")
        out = which.select("bucket", "cls", "label", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"of_{other}")).join(sets.select("cls", "shingles"), "cls")
        return out.toDF(*out.columns)  # columns of its own, as both sides come from the same rows

    key = ["bucket", "of_down", "of_across"]
    few, all_ = tiles(placed.where("label <> main"), "down", "across"), tiles(placed, "across", "down")
    return few.groupBy(*key).cogroup(all_.groupBy(*key)).applyInArrow(_links_in_tile(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text), extra columns unused.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z; a text's set is its distinct runs of k
    words, or its whole sequence if it has fewer. Two texts are linked if 100 * intersection >= percent * union. Texts
    with equal sets form one class, named by its smallest doc_id, so that copies are never paired. Each class enters one
    bucket per band; every bucket emits edges to its smallest class only (a star), which are confirmed on full sets. A
    bucket whose classes then still lie in several components is compared completely: pair by pair if small, otherwise
    in tiles, every member outside the largest component with every member. Null or empty texts: no shingles, own
    component. Rows that share a doc_id are one document; rows with a null doc_id take no part (component null, kept).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(map_arrow(texts, _signed(k), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # checkpointed, so that the joins read it by an exchange of their own and a hot key's rows can be split
    classes = cut(full.groupBy("set_key").agg(F.min("doc_id").alias("cls")))
    heads = full.join(classes.withColumnRenamed("cls", "doc_id"), ["set_key", "doc_id"])
    if not full.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat enter their buckets once
        heads = heads.dropDuplicates(["set_key", "doc_id"])
    banded = heads.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min(F.struct("cls", "n")).alias("star"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = cut(stars)
    shared = cut(banded.join(stars, "bucket").select("bucket", "cls", "n", "m", F.col("star.cls").alias("c"), F.col("star.n").alias("cn")))

    def fits(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    first = cut(shared.where("c <> cls").where(fits("n", "cn")).select(F.col("c").alias("a"), F.col("cls").alias("b")).distinct())
    groups = connected_components(_linked(texts, first, k, percent))

    seen = shared.join(groups, shared["cls"] == groups["node"], "left").select("bucket", "cls", "n", "m", F.coalesce("component", "cls").alias("label"))
    mixed = cut(seen.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"))
    seen = cut(seen.join(mixed, "bucket"))
    small = seen.where(F.col("m") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"))
    pairs = small.join(other, "bucket").where("a < cls and al <> label").where(fits("n", "an")).select("a", F.col("cls").alias("b"))
    second = cut(pairs.distinct().join(first, ["a", "b"], "left_anti"))
    found = [] if second.isEmpty() else [_linked(texts, second, k, percent)]
    large = cut(seen.where(F.col("m") > SMALL_BUCKET))
    if not large.isEmpty():
        found.append(_across_components(texts, large, k, percent))
    if found:
        edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        for more in found:
            edges = edges.union(more)
        groups = connected_components(edges)

    named = full.select("doc_id", "n_shingles", "set_key").join(classes, "set_key")
    named = named.join(groups, named["cls"] == groups["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
