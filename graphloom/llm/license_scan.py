"""License notices by diagonal voting over rolling word k-gram hashes, and plain phrase places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textops as X
from graphloom.llm.common import map_arrow

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of public license notices, and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Words of a gram, offsets by which neighbouring diagonals of one span may differ, and the least share of a template's grams.
GRAM, SLACK, COVERAGE = 3, 2, 0.6


def _base(phrases: dict[str, str]):
    wanted = [(X.word_hashes(p, X.ALNUM), label) for p, label in phrases.items()]
    names = sorted(set(phrases.values()))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in X.string_chunks(batch.column("text")):
                words, n = X.Words(data, offsets, X.ALNUM), end - at
                places, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels = np.zeros((n, len(names)), bool)
                for hashes, label in wanted:
                    i = np.flatnonzero(words.hash == hashes[0])
                    i = i[i + len(hashes) <= len(words.hash)]
                    for j, h in enumerate(hashes):
                        i = i[words.hash[i + j] == h]
                    i = i[words.text[i] == words.text[i + len(hashes) - 1]]
                    text = words.text[i]
                    places += np.bincount(text, minlength=n)
                    np.minimum.at(first, text, i - words.first[text])
                    np.maximum.at(last, text, i - words.first[text])
                    labels[text, names.index(label)] = True
                none = places == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        batch.column("text_key").slice(at, n),
                        pa.array(words.count),
                        pa.array(places),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([[x for x, has in zip(names, row, strict=True) if has] for row in labels], pa.list_(pa.string())),
                    ],
                    schema=schema,
                )

    return run


def _grams(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in X.string_chunks(batch.column("text")):
                hashes, text = X.Words(data, offsets, X.ALNUM).grams(k, short=False)
                bounds = np.searchsorted(text, np.arange(end - at + 1)).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), batch.column("text_key").slice(at, end - at), grams], schema=schema)

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, spans, score) for each row of (doc_id, text), extra columns unused.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, after lower-casing A-Z; a null
    text counts as empty. Every rolling gram of three words is joined with the grams of the notice templates. Matches
    vote for the diagonal (place in the text less place in the template); diagonals that differ by up to SLACK merge, so
    that an inserted or lost word does not split a notice. A merged span is verified: it must hold at least COVERAGE of
    the template's distinct grams within twice the template's length. ``spans`` are structs (label, first, last,
    coverage) in words; ``score`` is 1 with a base phrase, else the best coverage, else 0. Rows that repeat both doc_id
    and text share their spans; null ids are kept.
    """
    spark = docs.sparkSession
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    base = map_arrow(texts, _base(phrases), "doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")
    rows = []
    for number, (_, text) in enumerate(templates):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = X.Words(data, np.array([0, len(data)]), X.ALNUM).grams(GRAM, short=False)
        rows += [(int(h), number, place) for place, h in enumerate(hashes.view(np.int64))]
    wanted = F.broadcast(spark.createDataFrame(rows, "gram long, template int, place int"))  # as many rows as the templates have words
    about = F.broadcast(spark.createDataFrame([(n, label, len(text.split()), len({r[0] for r in rows if r[1] == n})) for n, (label, text) in enumerate(templates)], "template int, label string, words int, grams int"))
    each = map_arrow(texts, _grams(GRAM), "doc_id long, text_key long, grams array<long>").select("doc_id", "text_key", F.posexplode("grams").alias("pos", "gram"))
    key = ["doc_id", "text_key", "template"]
    votes = each.join(wanted, "gram").select(*key, "pos", "place", "gram").distinct()
    diagonals = votes.groupBy(*key, (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("gram").alias("found"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(1))
    merged = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy(*key, "span")
    merged = merged.agg(F.min("lo").alias("first"), (F.max("hi") + GRAM - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("hits"))
    spans = merged.join(about, "template").withColumn("coverage", F.col("hits") / F.col("grams"))
    spans = spans.where((F.col("coverage") >= COVERAGE) & (F.col("last") - F.col("first") + 1 <= 2 * F.col("words")))
    spans = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("label", "first", "last", "coverage"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), "spans")
    out = base.join(spans, base["doc_id"].eqNullSafe(spans["span_doc"]) & (base["text_key"] == spans["span_key"]), "left")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    empty = F.expr("cast(array() as array<struct<label:string,first:int,last:int,coverage:double>>)")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.coalesce("spans", empty).alias("spans"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(best, F.lit(1.0))).alias("score"))
