"""Shards under a byte limit, by extendible hashing.

Every document has a 128-bit key: a hash of its id and text, then a hash of its place in the table
of sizes, which tells equal rows apart. Buckets are key prefixes. They begin at the depth at which
the average bucket would just fit; then only buckets over the limit are split by one more bit, until
all fit. A bucket whose rows all share the first 64 bits goes straight to the bits of the place.
Only a document that is itself larger than the limit stays over it, alone in its shard.

All steps work on a table of (id, key, bytes), written once; the texts are read for it and no more.
Sums are taken per bucket before the shuffle, and rows of buckets that fit leave the loop.

Nulls and odd rows: a null text has no bytes; null ids are hashed like any value; repeated rows are
placed each by themselves; an empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.graph import keep_counted
from caseweave.storage import keep

LIMIT = 128 << 20


def _prefix(depth: Column) -> Column:
    """The first ``depth`` bits of the key, as text; depths up to 128."""
    return F.substring(F.col("bits"), F.lit(1), depth)


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", place: Column | None = None) -> DataFrame:
    """(id, bytes, place, bits): what shards are made of; bits is the key as 128 digits 0 and 1.

    ``place`` tells the rows apart; without it they are numbered.
    """
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.xxhash64(F.col(id_column), text).alias("h"), (F.monotonically_increasing_id() if place is None else place).alias("place"),
    )
    rows = keep(rows, "sizes")  # written, so that a place never changes
    digits = lambda c: F.lpad(F.bin(c), 64, "0")
    return rows.select("id", "bytes", "place", F.concat(digits(F.col("h")), digits(F.xxhash64("place", F.lit(1)))).alias("bits"))


def shard(docs: DataFrame, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, bytes, shard (the bucket's prefix), depth, shard_bytes."""
    return _dealt(sizes(docs, id_column, text_column), limit).drop("place").withColumnRenamed("id", id_column)


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of ``sizes`` with their shards: id, place, bytes, shard, depth, shard_bytes."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    start = max(0, math.ceil(math.log2(total / limit))) if total else 0
    rows, n = rows.withColumn("depth", F.lit(start)), 1
    done: list[DataFrame] = []
    while n:
        marked = rows.withColumn("shard", _prefix(F.col("depth")))
        buckets = marked.groupBy("depth", "shard").agg(
            F.sum("bytes").alias("shard_bytes"), F.count("*").alias("n"),
            (F.min(F.substring("bits", 1, 64)) == F.max(F.substring("bits", 1, 64))).alias("equal"),
        )
        more = F.greatest(F.lit(1), F.ceil(F.log2(F.col("shard_bytes") / limit))).cast("int")
        deeper = F.when(F.col("equal") & (F.col("depth") < 64), F.least(F.lit(128), 64 + more)).otherwise(F.col("depth") + 1)
        fits = (F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") >= 128)
        placed = keep(marked.join(buckets.withColumn("fits", fits).withColumn("next", deeper), ["depth", "shard"]), "placed")
        done.append(placed.filter("fits").select("id", "place", "bytes", "shard", "depth", "shard_bytes"))
        rows, n = keep_counted(placed.filter("not fits").select("id", "bytes", "place", "bits", F.col("next").alias("depth")), "oversized")
    return reduce(DataFrame.union, done)


def directory(placed: DataFrame) -> DataFrame:
    """(shard, depth, shard_bytes, n_docs, entries): the buckets, and how many entries of a directory
    as deep as the deepest bucket point to each."""
    buckets = placed.groupBy("shard", "depth", "shard_bytes").agg(F.count("*").alias("n_docs"))
    deepest = buckets.agg(F.max("depth")).scalar()
    return buckets.withColumn("entries", F.pow(F.lit(2.0), deepest - F.col("depth")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the documents as Parquet, a folder per shard. Rows are numbered in a table written once
    and matched to shards by their number, so repeated and null ids are placed each by themselves."""
    place = f"place_{uuid.uuid4().hex[:8]}"
    rows = keep(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")
    placed = _dealt(sizes(rows, place=F.col(place)), limit).select(F.col("place").alias(place), F.col("shard").alias("_shard"))
    rows.join(placed, place).drop(place).repartition("_shard").write.partitionBy("_shard").parquet(path)
