"""Connected components of an edge table, by contraction.

Each round every node is renamed to one of its neighbours or keeps its name; edges follow, loops and
repeats go. In even rounds a node takes the least name among itself and its neighbours, so a star
around its least node is gone at once. In odd rounds nodes with one neighbour take its name and the
others go by a mixed number, so stars around any node and ordered chains shrink as well. What is
shuffled is edges, reduced per node before the shuffle; only a count of edges reaches the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseweave.storage import keep


def keep_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written table and its rows, counted while it is written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return keep(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


HASHED = 16  # bits to a number, at least, when numbers are hashed
MOST_BITS = 1 << 28  # that are broadcast of hashed numbers


def marked(rows: DataFrame, number: Column, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: is ``number`` among those of ``found`` (one column, from 0)?

    Only bits are broadcast, 4096 bytes for each 32768 numbers in a row of which one was found; rows do not move.
    """
    own = F.col(found.columns[0])
    bits = found.groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits"))
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    return rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), "_bucket", "left").withColumn(name, there).drop("_bucket", "_bits")


def perhaps(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose ``column`` is among the ``n`` ids (a column of any longs), and of the others one in ``HASHED``
    at most: an exact join that follows has so much less to move. Of too many ids for that, exactly their rows."""
    wide = max(1 << 15, 1 << (HASHED * max(n, 1) - 1).bit_length())
    if wide > MOST_BITS:
        return rows.join(ids.withColumnRenamed(ids.columns[0], column), column, "left_semi")
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(wide))
    mark = f"_{uuid.uuid4().hex[:8]}"
    return marked(rows, hashed(column), ids.select(hashed(ids.columns[0]).alias("number")), mark).filter(mark).drop(mark)


def _edges(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all nodes of the edges (a long, b long); component is the least node reachable.

    Edges with a null end and loops are dropped. No edges give no rows.
    """
    left, n = keep_counted(_edges(edges), f"{name}-edges")
    if not n:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    steps: list[DataFrame] = []
    while n:
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if len(steps) % 2 == 0:
            to = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        else:
            mixed = lambda c: F.xxhash64(F.col(c), F.lit(len(steps)))  # noqa: B023, E731
            low = both.withColumn("r", mixed("v")).groupBy("u").agg(F.min(F.struct("r", "v")).alias("m"), F.count("*").alias("degree"))
            to = low.select("u", F.when((F.col("degree") == 1) | (F.col("m.r") < mixed("u")), F.col("m.v")).otherwise(F.col("u")).alias("to"))
        step = keep(to, f"{name}-step")
        steps.append(step)
        renamed = left.join(step.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        left, n = keep_counted(_edges(renamed, "x", "y"), f"{name}-edges")
    roots = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("u").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = keep(roots, f"{name}-roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return keep(roots.join(least, "root").select("node", "component"), name)


def merge(groups: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """Components after more edges: only the edges between different components are worked on."""
    own = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    named = edges.join(own("a"), "a", "left").join(own("b"), "b", "left")
    between = components(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), f"{name}-between")
    renamed = groups.join(between.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = between.join(groups.select("node"), "node", "left_anti")
    return keep(renamed.union(fresh.select("node", "component")), name)
