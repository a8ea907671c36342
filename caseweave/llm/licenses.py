"""License statements in documents, by diagonal voting.

Texts become rolling hashes of two and of three words. Spark joins them all to the places of the
same grams in the statements below. A hit at word p of a document and word t of a statement votes
for the diagonal p - t: one occurrence of the statement votes for one diagonal, or for some that lie
side by side where words were added or left out. Votes are summed by diagonal, near diagonals are
merged, and a merged span is verified by the share of the statement's words that its distinct hits
cover. The short base phrases are single grams, so each hit of theirs is a place.

The statements are the broadcast side: a fixed table of some hundred grams, whatever the input.

Nulls and odd rows: a null or empty text has no word and no span; repeated rows are scanned each by
themselves (rows are told apart by their place in the input, which should be a stored table); a null
doc_id is passed through; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm import words as W

# The base phrases and their labels, then well-known license notices.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
STATEMENTS = [
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0-1.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3.0"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
]

GRAMS = (2, 3)
SHIFT = 3  # diagonals of one span lie at most so far from the next
COVER = 0.75  # share of a statement's words that a span must cover
STRETCH = 1.5  # how much longer than the statement a span may be
_DOCUMENT = 0  # the statement number under which every document has one row


def _hashes(text: str) -> W.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.find_words(data, np.array([0, len(data)]), W.alphabet(W.NOT_ALPHANUMERIC, lower=True))


def templates(spark: SparkSession) -> DataFrame:
    """(k, gram, statement, t, label, length, base): where each gram stands in a statement."""
    rows = []
    for number, (text, label) in enumerate([*BASE, *STATEMENTS], start=1):
        words = _hashes(text)
        length, base = len(words.hash), number <= len(BASE)
        k = min(length, max(GRAMS))
        at, gram = W.windows(words, k)
        rows += [(k, int(g), number, int(t), label, length, base) for t, g in zip(at, gram.view(np.int64), strict=True)]
    return spark.createDataFrame(rows, "k int, gram long, statement int, t int, label string, length int, base boolean")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alpha = W.alphabet(W.NOT_ALPHANUMERIC, lower=True)
    for batch in W.pieces(batches):
        words = W.find_words(*W.text_bytes(batch.column("text")), alpha)
        n = len(batch)
        lists = []
        for k in GRAMS:
            at, gram = W.windows(words, k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(words.doc[at], minlength=n))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64))))
        n_words = pa.array(np.bincount(words.doc, minlength=n).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), n_words, *lists], names=["row", "doc_id", "n_words", *(f"g{k}" for k in GRAMS)])


def _diagonals(docs: DataFrame) -> DataFrame:
    """Hits by (row, statement, diagonal), and under statement 0 one row per document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = rows.mapInArrow(_grams, "row long, doc_id long, n_words long, " + ", ".join(f"g{k} array<long>" for k in GRAMS))
    each = F.concat(
        F.array(F.struct(F.lit(0).alias("k"), F.array(F.lit(0).cast("long")).alias("grams"))),
        *(F.array(F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("grams"))) for k in GRAMS),
    )
    lists = grams.select("row", "doc_id", "n_words", F.explode(each).alias("e"))
    rolled = lists.select("row", "doc_id", "n_words", F.col("e.k").alias("k"), F.posexplode("e.grams").alias("p", "gram"))
    mark = docs.sparkSession.createDataFrame([(0, 0, _DOCUMENT, 0, None, 1, False)], "k int, gram long, statement int, t int, label string, length int, base boolean")
    hits = rolled.join(F.broadcast(templates(docs.sparkSession).union(mark)), ["k", "gram"])
    return (
        hits.repartition("row")  # all that follows groups within a document
        .groupBy("row", "statement", (F.col("p") - F.col("t")).alias("diagonal"))
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
            F.first("length").alias("length"), F.first("base").alias("base"), F.first("k").alias("k"),
            F.count("*").alias("votes"), F.min("p").alias("low"), F.max(F.col("p") + F.col("k")).alias("high"), F.collect_set("t").alias("ts"),
        )
    )


def _verified(diagonals: DataFrame) -> DataFrame:
    """Merged diagonals with the share of the statement that they cover, those that cover enough."""
    order = Window.partitionBy("row", "statement").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT), F.lit(True))
    covered = F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.greatest(F.col("k"), F.lit(1)) - 1)))
    grouped = diagonals.withColumn("covered", covered).withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    merged = grouped.groupBy("row", "statement", "span").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("length").alias("length"), F.first("base").alias("base"), F.sum("votes").alias("votes"),
        F.min("low").alias("start"), F.max("high").alias("end"),
        F.collect_list("covered").alias("words"),
    )
    cover = F.size(F.array_distinct(F.flatten("words"))) / F.col("length")
    spans = merged.withColumn("cover", cover)
    enough = (F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= STRETCH * F.col("length"))
    return spans.filter((F.col("statement") == _DOCUMENT) | enough)


def license_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, label, start, end, cover, votes, base): verified spans in words from 0, end exclusive."""
    return _verified(_diagonals(docs)).filter(F.col("statement") != _DOCUMENT).select("row", "doc_id", "label", "start", "end", "cover", "votes", "base")


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: its words, its base places, the labels, and the best cover of any."""
    found, base = F.col("statement") != _DOCUMENT, F.col("base")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return (
        _verified(_diagonals(docs))
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum(F.when(found & base, 1).otherwise(0)).alias("n_base"),
            F.min(F.when(found & base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(found & base, F.col("start"))).cast("long").alias("last_word"),
            labels(found & base).alias("base_labels"), labels(found).alias("labels"),
            F.max(F.when(found, F.least(F.col("cover"), F.lit(1.0))).otherwise(0.0)).alias("score"),
        )
        .drop("row")
    )
