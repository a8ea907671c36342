"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

1. Vectors that are equal are one class. Each class is rotated by a fixed random orthogonal
   matrix (``ROTATIONS`` of them); the signs are its code. The code's inner product with the vector
   itself is its correction factor: it makes <code, q> / <code, v> an unbiased estimate of <v, q>,
   with a known spread, so each comparison comes with a confidence bound.
2. Sides of random hyperplanes make the keys of hash tables; each table has its own, so tables are
   independent for any two vectors. The number of bits grows with the logarithm of the number of
   vectors, and the number of tables so that two vectors at the threshold meet in one with chance
   ``1 - MISS``, at every size and dimension; work grows with a power of about 1.2 of the vectors, not 2.
3. Vectors of a bucket are compared in blocks within a task. A pair whose upper bound is below the
   threshold is dropped; all others are recomputed in double precision. A pair that meets in several
   tables counts in the first. A block returns per vector the links counted and the least vector
   of its linked group in the block, never pairs, so large groups of copies stay small.
4. A bucket larger than a block is cut into parts, and each two parts meet in a cell of their own.

Nulls and odd rows: null, empty, zero or non-finite vectors link with nothing and are their own
component; vectors of different length never meet; repeated rows are one node with its copies as
links; a null vec_id has no component and is not kept. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.graph import components
from caseweave.storage import keep

COSINE = 0.9
ROTATIONS = 4
MISS = 1e-3  # chance that a pair right at the threshold meets in no table
BOUND = 4.0  # standard deviations of the estimate that a dropped pair must lie below the threshold
PER_BUCKET = 32  # vectors of a bucket if all were spread evenly
BLOCK = 1024  # vectors of a part of a large bucket
MOST_BITS = 28
PAIRS = 1 << 16  # recomputed at a time


def shape_of_tables(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(n, 2) / PER_BUCKET)))) if n > PER_BUCKET else 1
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def rotations(dim: int) -> np.ndarray:
    """ROTATIONS random orthogonal matrices side by side (dim x ROTATIONS dim); the same everywhere."""
    rng = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(ROTATIONS)], axis=1)


def units(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision; no square overflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (+1 or -1) of unit vectors and their correction factors, the mean |coordinate| in units of 1/sqrt(bits)."""
    turned = unit @ rotations(unit.shape[1])
    return np.where(turned >= 0, 1, -1).astype(np.int8), np.abs(turned).sum(1)


@lru_cache(4)
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Random hyperplanes (tables x dim x bits), drawn apart from each other and from the rotations; the same everywhere."""
    return np.random.default_rng([dim, bits]).standard_normal((tables, dim, bits))


def table_keys(unit: np.ndarray, bits: int, tables: int, first: int | None = None) -> np.ndarray:
    """The key of each vector in each table (or the ``first`` ones): its sides of the table's own hyperplanes."""
    normals = planes(unit.shape[1], bits, tables)[:first]
    out = np.empty((len(unit), len(normals)), np.int32)
    weights = 1 << np.arange(bits)
    for t, normal in enumerate(normals):
        out[:, t] = (unit @ normal > 0) @ weights
    return out


def _upper(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors (rows) with whole vectors (columns).

    With R rotations a code is a vector of length sqrt(R dim); ``factors`` is its product with the
    turned vector, whose own length is sqrt(R). The cosine of that angle says how much of the code is noise.
    """
    dim = unit.shape[1]
    turned = unit @ rotations(dim).astype(np.float32)
    estimate = (codes.astype(np.float32) @ turned.T) / factors[:, None]
    share = np.clip(factors / (ROTATIONS * math.sqrt(dim)), 1e-6, 1.0)
    spread = np.sqrt((1 - share**2) / share**2) / math.sqrt(max(1, ROTATIONS * dim - 1))
    return estimate + BOUND * spread[:, None]


def _groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place of each place's linked group, by spreading minima."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(block: pd.DataFrame, table: int, cosine: float, bits: int, tables: int, across: bool) -> pd.DataFrame:
    """Links of one block that it is the first table to show; ``across``: only between its two parts."""
    unit = units(block["v"])
    codes, factors = encode(unit)
    likely = _upper(codes, factors, unit.astype(np.float32)) >= cosine
    part = block["part"].to_numpy()
    if across:
        likely &= part[:, None] < part[None, :]
    else:
        likely &= np.triu(np.ones_like(likely), 1)
    i, j = np.nonzero(likely)
    ids, n = block["vec_id"].to_numpy(), block["n"].to_numpy()
    yes = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):  # bounded memory however many pairs are left
        yes[at : at + PAIRS] = np.einsum("ij,ij->i", unit[i[at : at + PAIRS]], unit[j[at : at + PAIRS]]) >= cosine
    i, j = i[yes], j[yes]
    if table and len(i):
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = table_keys(unit[used], bits, tables, table)
        a, b = place[: len(i)], place[len(i) :]
        fresh = np.ones(len(i), bool)
        for at in range(0, len(i), PAIRS):
            fresh[at : at + PAIRS] = (keys[a[at : at + PAIRS]] != keys[b[at : at + PAIRS]]).all(1)
        i, j = i[fresh], j[fresh]
    links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    least = ids[order][_groups(len(ids), place[i], place[j])[place]]
    some = links > 0
    return pd.DataFrame({"vec_id": ids[some], "links": links[some].astype(np.int64), "least": least[some]})


CELL = ["cell", "dim", "first_part", "second_part"]


def _compared(cosine: float, bits: int, tables: int):
    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell; a cell may go on in the next frame and is about two parts at most."""
        rest: pd.DataFrame | None = None

        def run(cell: pd.DataFrame) -> pd.DataFrame:
            head = cell.iloc[0]
            return _compare(cell, int(head["cell"]) % tables, cosine, bits, tables, head["first_part"] != head["second_part"])

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            name = frame[CELL].to_numpy()
            starts = np.concatenate([[0], 1 + np.flatnonzero((name[1:] != name[:-1]).any(axis=1))])
            out = [run(frame.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
            rest = frame.iloc[starts[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) > 1:
            yield run(rest)

    return compared


def _described(bits: int, tables: int):
    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby("dim"):
                yield same.assign(keys=list(table_keys(units(same["v"]), bits, tables)))

    return described


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least vec_id reachable), kept."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    hashed = usable.withColumn("hash", F.xxhash64("v")).withColumn("hash2", F.xxhash64("v", F.lit(1)))
    classes = keep(hashed.groupBy("hash", "hash2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    copies = keep(hashed.select("vec_id", "hash", "hash2").join(classes.filter("n > 1"), ["hash", "hash2"]).select("vec_id", "rep", "n"), "copies")

    bits, tables = shape_of_tables(classes.count(), cosine, miss)
    stands = hashed.join(classes, ["hash", "hash2"]).filter("vec_id = rep").dropDuplicates(["vec_id", "hash", "hash2"]).select("vec_id", "n", "v", F.size("v").alias("dim"))
    described = keep(stands.mapInPandas(_described(bits, tables), f"vec_id long, n long, v {kind}, dim int, keys array<int>"), "codes")
    # the number of a cell is its key and its table in one
    spread = described.select("vec_id", "dim", F.posexplode("keys").alias("table", "key")).select("vec_id", "dim", (F.col("key").cast("long") * tables + F.col("table")).alias("cell"))
    size = spread.groupBy("cell", "dim").agg(F.count("*").alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / block).cast("int")
    placed = spread.join(size, ["cell", "dim"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("x"), F.greatest(p, F.col("part")).alias("y")))
    cells = placed.withColumn("m", F.explode(meets)).select("cell", "dim", F.col("m.x").alias("first_part"), F.col("m.y").alias("second_part"), "part", "vec_id")
    full = cells.join(described.select("vec_id", "n", "v"), "vec_id")
    blocks = full.repartition(*CELL).sortWithinPartitions(*CELL)
    found = keep(blocks.mapInPandas(_compared(cosine, bits, tables), "vec_id long, links long, least long"), "links")

    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")).union(copies.select("vec_id", "rep"))
    group = components(edges, "vectors")
    counted = copies.select("vec_id", "rep", "n").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    single = links.join(copies.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.col("links").alias("n_links"))
    total = counted.union(single).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(total, "vec_id", "left").join(group.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
