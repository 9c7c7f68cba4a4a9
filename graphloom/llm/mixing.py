"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

#: Pieces of a rank for each unit of its logarithm. With a probability of its own, a document's logarithm of the rank has a
#: logistic distribution, whose density is at most 1/4, so a piece holds at most a thousandth of a source's drawn documents.
STEPS = 256
#: Sources of a part of their order, about.
PART_ROWS = 1_000_000
#: Hexadecimal digits of the random number of a document.
DIGITS = 13


def running_sums(rows: DataFrame, order: list[Column], of: dict[str, Column]) -> DataFrame:
    """The rows with sums of what stands before each in an order without ties; checkpointed.

    Rows are dealt by ranges of the order, so that a task sorts about PART_ROWS of them; only the ranges' totals, a row
    each, are summed by a single task.
    """
    parts = rows.count() // PART_ROWS + 1
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("@part", F.spark_partition_id()))
    totals = placed.groupBy("@part").agg(*[F.sum(v).alias(k) for k, v in of.items()])
    earlier = Window.orderBy("@part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("@part").alias("@of"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"@{k}") for k in of])
    own = Window.partitionBy("@part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({k: F.coalesce(F.sum(v).over(own), F.lit(0)) for k, v in of.items()}).join(F.broadcast(totals), F.col("@part") == F.col("@of"))
    return cut(out.withColumns({k: F.col(k) + F.col(f"`@{k}`") for k in of}).drop("@part", "@of", *[f"@{k}" for k in of]))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, take the weights in turn. Targets share ``share`` of all sizes by weight, but
    stop at ``most`` times the source's size; what is over is shared again among the rest, until none is above: the
    sources are capped in the order of most * size / weight, as far as the level of the rest exceeds it.
    """
    up, down = share
    by_name = F.col("source").asc_nulls_last()
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = running_sums(cut(sources), [by_name], {"place": F.lit(1).cast("long")})
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    total, all_weights = sources.agg(F.sum("source_size"), F.sum("w")).first()
    ratio = F.col("source_size") / F.col("w")
    sources = running_sums(sources, [ratio.asc(), by_name], {"before": F.col("source_size"), "before_w": F.col("w")})
    sources = sources.withColumns({"capped": F.col("before") * most, "left_w": F.lit(all_weights or 0) - F.col("before_w")})
    sources = sources.withColumn("over", F.col("w") * (F.lit(up * (total or 0)).cast("long") - down * F.col("capped")) >= most * F.col("source_size") * down * F.col("left_w"))
    # the first source that isn't over its cap sets the level of all after it
    level = sources.where("not over").agg(F.min(F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), "source", "capped", "left_w"))).first()[0]
    capped = (most * F.col("source_size")).cast("double")
    if level is None:
        return sources.select("source", "source_size", capped.alias("target"))
    shared = (F.col("w") * (up * total - down * level["capped"])).cast("double") / F.lit(down * level["left_w"]).cast("double")
    return sources.select("source", "source_size", F.when(F.col("over"), capped).otherwise(shared).alias("target"))


def random_number(docs: DataFrame, seed: str) -> Column:
    """A number from 0 to 16**DIGITS - 1 that depends on seed, doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def inclusion(rows: DataFrame) -> DataFrame:
    """(source, size, probability) for each size that a source has, from (source, size, rest): ``rest`` words of a source are to be drawn.

    A document's probability is proportional to its size, min(1, c * size), with c such that the expected words are the
    rest: sizes are made certain in descending order, as far as c of the smaller ones exceeds 1 / size. A source with W
    words has at most sqrt(2 * W) sizes, so that a window may hold them.
    """
    sizes = rows.where("size > 0").groupBy("source", "size", "rest").agg(F.count(F.lit(1)).alias("n"))
    exact = "decimal(38,0)"
    sizes = sizes.withColumn("words", F.col("n") * F.col("size")).withColumn("squares", F.col("words").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)"))
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("open", F.col("rest") - F.coalesce(F.sum("words").over(larger), F.lit(0))).withColumn("below", F.sum(F.col("squares").cast(exact)).over(smaller).cast("double"))
    sizes = sizes.withColumn("certain", F.col("open").cast("double") * F.col("size").cast("double") >= F.col("below"))
    # the largest size that isn't certain sets c for all that are smaller
    level = F.max(F.when(~F.col("certain"), F.struct("size", "open", "below"))).over(Window.partitionBy("source"))
    sizes = sizes.withColumn("level", level)
    share = F.greatest(F.lit(0.0), F.col("level.open").cast("double") * F.col("size").cast("double") / F.col("level.below"))
    return sizes.select("source", "size", F.when(F.col("certain") | F.col("level").isNull(), 1.0).otherwise(share).alias("probability"))


def rank_of(drawn: Column, probability: Column) -> Column:
    """The Pareto rank: random odds divided by inclusion odds; 0 for a certain document, null for one that is never drawn."""
    u = (drawn + F.lit(0.5)) / F.lit(float(16**DIGITS))
    odds = (u / (F.lit(1.0) - u)) / (probability / (F.lit(1.0) - probability))
    return F.when(probability >= 1, F.lit(0.0)).when(probability > 0, odds)


def pareto_mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, certain, probability, drawn, rank, copies, taken) for each row of (doc_id, source); ``size`` is a column of it.

    A source whose target is r times its size takes floor(r) certain whole copies of each document. The rest of the
    target is drawn by Pareto order sampling: a document's inclusion probability p is proportional to its size within
    the source, at most 1 (``inclusion``), and with its random number u it has the rank (u / (1 - u)) / (p / (1 - p)).
    The documents of least rank are taken: those of p = 1 first, then the others until the rest of the target is full.
    The fixed size of the sample is counted in words; the last document gives only the words still missing. With
    ``whole``, that one is taken whole if at least half of it fits, else not at all.

    u comes from the MD5 of seed, doc_id and text, so reruns agree; rows that repeat all of these are interchangeable,
    and ties of rank go by u, then doc_id, null last, then size. Null sizes count as 0 and are never drawn, a null source
    is a source of its own, null ids are kept; an empty table gives an empty one. Extra columns are not read.
    """
    drawn = random_number(docs, seed).alias("drawn")
    # without texts from here on
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.greatest(F.lit(0), F.coalesce(size.cast("long"), F.lit(0))).alias("size"), drawn))
    targets = source_targets(rows, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut(targets.withColumn("certain", copies).withColumn("rest", F.round("target").cast("long") - F.col("certain") * F.col("source_size")))
    placed = _joined(rows, targets, ["source"])
    placed = _joined(placed, cut(inclusion(placed)), ["source", "size"]).withColumn("rank", rank_of(F.col("drawn"), F.col("probability")))
    # Certain documents need no order, as all of them fit. The others are ordered by pieces of the rank's logarithm.
    piece = F.when((F.col("probability") < 1) & F.col("rank").isNotNull(), F.floor(F.log("rank") * STEPS).cast("int"))
    placed = cut(placed.withColumn("piece", piece).drop("n"))
    by_piece = placed.where("size > 0 and rank is not null").groupBy("source", F.coalesce("piece", F.lit(-(1 << 31))).alias("piece")).agg(F.sum("size").alias("piece_size"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    by_piece = cut(by_piece.select("source", "piece", F.coalesce(F.sum("piece_size").over(earlier), F.lit(0)).alias("before")))
    own = Window.partitionBy("source", "piece").orderBy("rank", "drawn", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = _joined(placed.where("piece is not null").withColumn("own_before", F.coalesce(F.sum("size").over(own), F.lit(0))), by_piece, ["source", "piece"])
    left = F.col("rest") - F.col("before") - F.col("own_before")
    fitting = F.greatest(F.lit(0), F.least("size", left))
    if whole:
        fitting = F.when((2 * fitting >= F.col("size")) & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0))
    certain = F.when(F.col("rank") == 0, F.col("size")).otherwise(F.lit(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "certain", "probability", "drawn", "rank"]
    out = ordered.select(*columns, fitting.cast("long").alias("more")).union(placed.where("piece is null").select(*columns, certain.cast("long").alias("more")))
    return out.select(*columns, (F.col("certain") + (F.col("more") > 0).cast("long")).alias("copies"), (F.col("certain") * F.col("size") + F.col("more")).alias("taken"))


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with a checkpointed table's other columns, by keys of which the first may be null; the table is broadcast if a count shows that it is small."""
    if table.count() <= 100_000:
        table = F.broadcast(table)
    named = table.withColumnsRenamed({k: f"@{k}" for k in keys})
    test = rows[keys[0]].eqNullSafe(named[f"`@{keys[0]}`"])
    for k in keys[1:]:
        test = test & (rows[k] == named[f"`@{k}`"])
    return rows.join(named, test, "left").drop(*[f"@{k}" for k in keys])


def mixed_rows(docs: DataFrame, size: Column, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix of whole documents takes it.

    Within a source the drawn documents are those up to a last rank, and the rank follows from a document's size and
    random number; so tables of sources and of their sizes, not one of documents, say how often each row is repeated.
    Documents of size 0 are not drawn, only copied. Rows that repeat doc_id, text and source are drawn together. Null
    ids, sources and texts, extra columns and empty tables are as for ``pareto_mix``.
    """
    mix = cut(pareto_mix(docs, size, seed=seed, whole=True, **options))
    last = F.max(F.when(F.col("copies") > F.col("certain"), F.struct("rank", "drawn"))).alias("@last")
    sources = cut(mix.groupBy("source").agg(F.max("certain").cast("int").alias("@certain"), last))
    sizes = cut(mix.where("size > 0").groupBy("source", "size").agg(F.max("probability").alias("@probability")))
    rows = docs.withColumns({"@drawn": random_number(docs, seed), "@size": F.coalesce(size.cast("long"), F.lit(0))})
    for table, keys in ((sources, {"source": "@source"}), (sizes, {"source": "@of", "size": "@words"})):
        table = table.withColumnsRenamed(keys)
        test = rows["source"].cast("string").eqNullSafe(table[f"`{keys['source']}`"])
        if "size" in keys:
            test = test & (rows["`@size`"] == table["`@words`"])
        rows = rows.join(F.broadcast(table) if table.count() <= 100_000 else table, test, "left")
    rank = rank_of(F.col("`@drawn`"), F.col("`@probability`"))
    drawn = F.coalesce(F.struct(rank.alias("rank"), F.col("`@drawn`").alias("drawn")) <= F.col("`@last`"), F.lit(False)) & (F.col("`@size`") > 0) & rank.isNotNull()
    return rows.withColumn("@copy", F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("`@certain`"), F.lit(0)) + drawn.cast("int")))).select(*docs.columns)
