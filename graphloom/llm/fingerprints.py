"""Document fingerprints from closed syncmers of words, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer and of its inner s-mers. A fingerprint has all anchors up to a bound: the 128th least of the text's, but
#: at least a quarter of the range of anchors, so that it grows with the text; of a text with fewer anchors it has all.
K, S, ANCHORS, QUARTER = 4, 2, 128, 1 << 30
#: Rows between two bounds by which rows are dealt to find each document's successor, about, and least number of bounds, about.
PIECE_ROWS, PIECES = 20_000, 1024


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """The words of a text, a word being a run of characters other than ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def syncmers(words: Column, k: int = K, s: int = S, places: bool = False) -> Column:
    """Array of the anchors of the closed syncmers among the k-mers of words: those whose least s-mer is the first or the last; with ``places``, of (pos, anchor).

    s-mers compare by the hash of their words, s at least 1 and less than k. Whether a k-mer is chosen depends on its own
    words alone, so equal passages give equal anchors wherever they stand. Fewer than k words, or no chosen k-mer: one
    anchor at 0 for the whole sequence; no words: none.
    """
    kind = "array<struct<pos:int,anchor:bigint>>" if places else "array<bigint>"

    def shown(pos: Column, anchor: Column) -> Column:
        return F.struct(pos.alias("pos"), anchor.alias("anchor")) if places else anchor

    def inner(w: Column) -> Column:
        def smer(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *[F.get(w, i + j) for j in range(1, s)])

        def chosen(g: Column) -> Column:
            def anchor(x: Column, i: Column) -> Column:
                last = F.get(g, i + (k - s))
                between = [F.get(g, i + j) for j in range(1, k - s)]
                edge = F.least(x, last)
                is_edge = edge <= (F.least(*between) if len(between) > 1 else between[0]) if between else F.lit(True)
                # s-mers that follow each other without a gap, and the last one, tell all words of the k-mer
                return F.when(is_edge & (i + k <= F.size(w)), shown(i, F.xxhash64(x, *[F.get(g, i + j) for j in range(s, k - s, s)], last)))

            return F.array_compact(F.transform(g, anchor))

        whole = F.when(F.size(w) == 0, F.expr(f"cast(array() as {kind})")).otherwise(F.array(shown(F.lit(0), F.xxhash64(w))))
        found = F.when(F.size(w) >= k, let(F.transform(w, smer), chosen))
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    return let(words, inner)


def sketch(text: Column, k: int = K, s: int = S, anchors: int = ANCHORS) -> Column:
    """A text's distinct anchors as ascending 32-bit numbers: all up to the bound that ``bound_of`` gives again."""
    low = F.transform(syncmers(words_of(text), k, s), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))

    def kept(found: Column) -> Column:
        few = F.size(found) <= anchors
        return F.when(few, found).otherwise(F.concat(F.slice(found, 1, anchors), F.filter(F.slice(found, anchors + 1, F.greatest(F.lit(1), F.size(found) - anchors)), lambda x: x < QUARTER)))

    return let(F.sort_array(F.array_distinct(low)), kept)


def as_text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def bound_of(own: Column, anchors: int = ANCHORS) -> Column:
    """The number up to which a sketch has all anchors of its text."""
    return F.when(F.size(own) < anchors, F.lit(1 << 32)).otherwise(F.greatest(F.get(own, F.lit(anchors - 1)), F.lit(QUARTER - 1)))


def likeness(a: Column, b: Column, anchors: int = ANCHORS) -> Column:
    """Share of common anchors of two sketches up to the lower of their bounds, 2 * both / (first + second): 1 if both are empty, 0 if one is."""

    def upto(bound: Column) -> Column:
        def size(x: Column) -> Column:
            return F.size(F.filter(x, lambda y: y <= bound))

        return 2 * size(F.array_intersect(a, b)) / (size(a) + size(b))

    some = let(F.least(bound_of(a, anchors), bound_of(b, anchors)), upto)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(some)


def anchor_places(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, pos, anchor) of every closed syncmer of every (doc_id, text): the index for positional matching."""
    return docs.select("doc_id", F.explode(syncmers(words_of(F.coalesce("text", F.lit(""))), k, s, places=True)).alias("x")).select("doc_id", "x.pos", "x.anchor")


def positional_matches(places: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, shift, shared): anchors that a stated set of query documents shares with other documents, by the difference of their places. Both come from anchor_places."""
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("pos").alias("query_pos"), "anchor")
    same = places.join(q, "anchor").where("doc_id <> query_id")
    return same.groupBy("query_id", "doc_id", (F.col("pos") - F.col("query_pos")).alias("shift")).agg(F.count(F.lit(1)).alias("shared"))


def with_successor(rows: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: the value of the next row by ascending key (null first), after the last row that of the first.

    Rows with the same key are ordered by the hash of the text. Rows are dealt by bounds on key and hash, so that rows of
    one key may be dealt apart: those of the rows whose hash of both is a multiple of some number, about one in
    PIECE_ROWS. The plan holds the bounds as two arrays, 16 bytes for PIECE_ROWS rows. A piece also gets the first row
    of the piece after it, so that no window spans more than a piece.
    """
    k, h = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), F.xxhash64(text)
    placed = rows.select(k.alias("k"), h.alias("h"))
    each = max(1, min(PIECE_ROWS, rows.count() // PIECES))
    found = placed.where(F.pmod(F.xxhash64("k", "h"), F.lit(each)) == 0).distinct().union(placed.agg(F.min(F.struct("k", "h")).alias("x")).where("x is not null").select("x.k", "x.h"))
    bounds = sorted({(r.k, r.h) for r in found.collect()})
    if not bounds:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    at_k, at_h = (F.lit(np.array([b[i] for b in bounds], np.int64)) for i in (0, 1))
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]

    def reaches(at: Column) -> Column:
        own = F.get(at_k, at)
        return (own < F.col("@k")) | ((own == F.col("@k")) & (F.get(at_h, at) <= F.col("@h")))

    piece = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(-1), lambda i, s: F.when((i + s < len(bounds)) & reaches(i + s), i + s).otherwise(i))
    dealt = rows.withColumns({"@k": k, "@h": h}).withColumn("@piece", piece)
    home = F.struct(F.col("@piece").alias("piece"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("@piece") + len(bounds) - 1) % len(bounds)).alias("piece"), F.lit(True).alias("guest"))
    is_first = (F.get(at_k, F.col("@piece")) == F.col("@k")) & (F.get(at_h, F.col("@piece")) == F.col("@h"))
    dealt = dealt.withColumn("@at", F.explode(F.when(is_first, F.array(home, guest)).otherwise(F.array(home))))
    order = Window.partitionBy("@at.piece").orderBy("@at.guest", "@k", "@h")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return out.where(~F.col("@at.guest")).drop("@k", "@h", "@piece", "@at")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(length / 4) code points replaced by the first as many (or all) of the following text."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_with_edit(docs: DataFrame, k: int = K, s: int = S, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of (doc_id, text), extra columns unused.

    A fingerprint is the text, eight hexadecimal digits each, of the distinct closed-syncmer anchors up to a bound: all of
    a text with up to ANCHORS of them, else the ANCHORS least and all others in the lowest quarter of the range. So it
    grows with the text, and the likeness of two texts counts their common anchors up to the lower bound. Equal texts
    have equal fingerprints, and an empty or null text (taken as empty) has the empty one. A null doc_id stands before
    all others; rows with equal ids are ordered by the hash of their text, and such with equal texts too are
    interchangeable. One row is its own successor; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_successor(rows.withColumn("own", sketch(F.col("text"), k, s, anchors)), "doc_id", "text", ["text", "own"])
    rows = rows.select("doc_id", "text", "own", "next_own", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.withColumn("then", sketch(F.col("edited"), k, s, anchors))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("then")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("then"), anchors).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), anchors).alias("near_next"),
    )
