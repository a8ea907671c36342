"""Near-duplicate documents by one-permutation MinHash.

1. One pass over the texts makes, per document, the size and a 128-bit sum of its shingle set and
   one key per band of its signature. The signature has one hash of the set in each of ``BINS``
   bins; an empty bin takes the value of the bin that a fixed sequence of probes, the same for all
   documents, finds first (optimal densification).
2. Documents with the same set are one class, stood for by its least doc_id.
3. Classes that share a band key are a bucket. Candidates are stars: each class with the centre it
   shares most buckets with, so a bucket of n gives n - 1 pairs at most.
4. A pair's texts move only if its sketches and set sizes allow a link. A sketch has a byte for each of 512
   bins; the share of equal bins must reach 0.8 less ``DEVIATIONS`` standard deviations of that share.
   Links are then confirmed on the full sets and joined to components.
5. A bucket whose members lie in several components has pairs that nobody has compared. Its sketches are
   compared in blocks of ``BLOCK`` by ``BLOCK`` members inside tasks; what leaves a
   block is, for each member, the two likeliest pairs with other components that sketches and sizes allow, in
   later rounds more of them. So copies meet the text they are copies of before they meet each
   other. Open buckets that share most of their members are put together, so that a pair is not compared once
   per band; one whose likely pairs have all been tested is done. Rounds end when no likely pair between components is untested.

Two sets with a similarity of 0.8 share no band with a chance of (1 - 0.8^6)^42, 3 in a million; two
with 0.85, 2 in 10^9. That their sketches deny the link has a chance of 3 in 100,000 at 0.8. Larger
buckets with the same members are one bucket.

Nulls and odd rows: a text without words (null, empty or white space) has an empty set and is linked
with nothing; rows that share a doc_id are one node of the link graph; a null doc_id has no
component and is not kept; a text with fewer words than a shingle has one shingle, all its words.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm import words as W
from caseweave.llm.graph import components, keep_counted, marked, merge, perhaps
from caseweave.storage import keep

BINS = 256
ROWS_PER_BAND = 6
SHINGLE_WORDS = 4
SIMILARITY_PERCENT = 80
SKETCH = 512  # bins of the bytes that pairs are judged by before texts move
DEVIATIONS = 4
BLOCK = 1024  # members of a bucket that are compared with as many at once
WITNESSES = 4  # largest buckets of a member that its other ones may join
_BIN_SHIFT = W.U64(64 - BINS.bit_length() + 1)
_SKETCH_SHIFT = W.U64(64 - SKETCH.bit_length() + 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, in a row, and how many each text has."""
    words = W.find_words(data, offsets, W.alphabet(W.SPACES, lower=True))
    n = len(offsets) - 1
    at, gram = W.windows(words, k)
    owner = words.doc[at]
    counts = np.bincount(words.doc, minlength=n)
    ends = np.cumsum(counts)
    sets = np.split(gram, np.cumsum(np.bincount(owner, minlength=n))[:-1])
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hash[ends[row] - counts[row] : ends[row]]
        whole = W.U64(counts[row]) + np.zeros(1, W.U64)
        for h in own:
            whole = W.mix(whole * W.U64(0x9E3779B97F4A7C15) + h)
        sets[row] = whole
    for row, hashes in enumerate(sets):
        if len(hashes) > 1:
            hashes = np.sort(hashes)
            sets[row] = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
    return np.concatenate(sets) if sets else gram, np.array([len(s) for s in sets], np.int64)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One-permutation signatures with optimal densification: a row of BINS values per text."""
    n = len(sizes)
    row, bins = np.repeat(np.arange(n), sizes), (hashes >> _BIN_SHIFT).astype(np.int64)
    place = row * BINS + bins
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)  # sets ascend, so the first is the least
    out, filled = np.zeros(n * BINS, W.U64), np.zeros(n * BINS, bool)
    out[place[first]] = hashes[first]
    filled[place[first]] = True
    empty = np.flatnonzero(~filled & np.repeat(sizes > 0, BINS))
    attempt = 0
    while len(empty):
        attempt += 1
        probe = W.mix((empty % BINS).astype(W.U64) * W.U64(0x9E3779B97F4A7C15) + W.U64(attempt)) >> _BIN_SHIFT
        source = empty - empty % BINS + probe.astype(np.int64)
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out.reshape(n, BINS)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A byte per bin of ``SKETCH``: 0 for an empty one, else 1 to 255 of its least hash. Nothing is filled up."""
    place = np.repeat(np.arange(len(sizes)), sizes) * SKETCH + (hashes >> _SKETCH_SHIFT).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    out = np.zeros(len(sizes) * SKETCH, np.uint8)
    out[place[first]] = hashes[first] % W.U64(255) + W.U64(1)
    return out.reshape(len(sizes), SKETCH)


def _described(k: int, rows_per_band: int):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            hashes, sizes = shingle_sets(*W.text_bytes(batch.column("text")), k)
            n, bands = len(sizes), BINS // rows_per_band
            signature = signatures(hashes, sizes)
            keys = np.zeros((n, bands), W.U64) + np.arange(bands, dtype=W.U64)
            for j in range(rows_per_band):
                keys = W.mix(keys * W.U64(0x9E3779B97F4A7C15) + signature[:, j : bands * rows_per_band : rows_per_band])
            sums = [np.concatenate([[W.U64(0)], np.cumsum(W.mix(hashes + W.U64(seed)))]) for seed in (1, 2)]
            ends = np.cumsum(sizes)
            high, low = (s[ends] - s[ends - sizes] for s in sums)
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat),
                    pa.array([row.tobytes() for row in sketches(hashes, sizes)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "high", "low", "bands", "signature"],
            )

    return described


def describe(docs: DataFrame, k: int = SHINGLE_WORDS, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_described(k, rows_per_band), "doc_id long, n_shingles long, high long, low long, bands array<long>, signature binary")


def may_link(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Do sizes and sketches allow a link? And the share of equal bins among those that either set fills.

    Bins are a sample of the union, one of each; it is nearly all of a small union, so its share is then
    nearly exact. A pair right at the limit is denied at ``DEVIATIONS`` standard deviations.
    """
    either = np.maximum(np.count_nonzero(one | other, axis=1), 1)
    equal = np.count_nonzero((one == other) & (one != 0), axis=1) / either
    share = percent / 100
    left_out = np.maximum(1 - either * (1 + share) / np.maximum(n + m, 1), 0.02)
    least = share - DEVIATIONS * np.sqrt(share * (1 - share) / either * left_out)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (equal >= least), equal


def _likely(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("of_a", "of_b"))
            yes, _ = may_link(left, right, n, m, percent)
            yield batch.select(["a", "b"]).filter(pa.array(yes))

    own = lambda c: described.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"of_{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(allowed, "a long, b long")


def _between_components(open_: DataFrame, described: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, unfinished) from buckets (key, rep, component): for each member of a block its ``most`` likeliest pairs
    with other components; a row with ``unfinished`` names a bucket that has more of them."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            key, _, _, side, rep, component, size, signature = rows
            first = side == side.min() if side.min() < side.max() else np.ones(len(rep), bool)
            second = ~first if not first.all() else first
            at, other = np.flatnonzero(first), np.flatnonzero(second)
            out, unfinished = [], False
            for one in at.tolist():
                rest = other[(component[other] != component[one]) & (100 * np.minimum(size[other], size[one]) >= percent * np.maximum(size[other], size[one]))]
                if not len(rest):
                    continue
                yes, equal = may_link(signature[one][None, :], signature[rest], size[one], size[rest], percent)
                rest, equal = rest[yes], equal[yes]
                best = rest[np.lexsort((rest, -equal))[:most]]
                out += [(rep[one], b) for b in rep[best].tolist()]
                unfinished |= len(rest) > most
            if out:
                a, b = (np.array(c) for c in zip(*out, strict=True))
                names = pa.array([key[0] if unfinished else None] + [None] * (len(out) - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), names], names=["a", "b", "unfinished"])

    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    own = described.select(F.col("doc_id").alias("rep"), "n_shingles", "signature")
    rows = open_.join(sizes, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = blocks.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "component")
    dealt = placed.join(own, "rep").select("key", "i", "j", "side", "rep", "component", "n_shingles", "signature").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compared, "a long, b long, unfinished long")


def _gathered(open_: DataFrame) -> DataFrame:
    """The rows of buckets (key, rep, component), buckets that share most members put together.

    A bucket takes the name of the largest one that at least half of its members are in, as far as the ``WITNESSES``
    largest buckets of each member tell; all its rows do, so no pair is lost. A name under which more comparisons
    would be made than by its buckets apart is not taken. A member has one bucket per band at most; rows are distinct.
    """
    sizes = open_.groupBy("key").agg(F.count("*").alias("n"))
    own = open_.join(sizes, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("buckets"))
    pairs = own.select(F.explode("buckets").alias("inner"), F.slice("buckets", 1, WITNESSES).alias("largest"))
    pairs = pairs.select("inner", F.explode("largest").alias("outer")).filter("outer > inner")
    shared = pairs.groupBy("inner", "outer").agg(F.count("*").alias("shared")).filter("2 * shared >= inner.n")
    to = shared.groupBy(F.col("inner.key").alias("key")).agg(F.max("outer").alias("to"))
    names = keep(sizes.join(to, "key", "left").select("key", F.col("n").cast("double").alias("n"), F.coalesce("to.key", "key").alias("name")), "names")
    moved = names.filter("name <> key")
    full = open_.join(names, "key").select("name", "rep").distinct().groupBy("name").agg(F.count("*").cast("double").alias("members"))
    apart = names.groupBy("name").agg(F.sum(F.col("n") * F.col("n")).alias("comparisons"))
    worth = full.join(apart, "name").filter("members * members <= comparisons").select("name")
    moved = moved.join(worth, "name", "left_semi").select("key", "name")
    return open_.join(moved, "key", "left").select(F.coalesce("name", "key").alias("key"), "rep", "component").distinct()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of neighbouring rows with the same key, i and j; signatures as a matrix."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
        columns.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, SKETCH))
        if not len(batch):
            continue
        edges = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            part = [c[a:b] for c in columns]
            if held and any(held[0][k][0] != part[k][0] for k in range(3)):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are as similar as asked.

    ``pairs`` is read three times and should be a kept table; only texts that stand in a pair move.
    """

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(W.pieces(batches, "text_a"), "text_b"):
            left, right = (shingle_sets(*W.text_bytes(batch.column(c)), k) for c in ("text_a", "text_b"))
            end_l, end_r = np.cumsum(left[1]), np.cumsum(right[1])
            yes = np.zeros(len(batch), bool)
            for row, (n, m) in enumerate(zip(left[1], right[1], strict=True)):
                if n and m and 100 * min(n, m) >= percent * max(n, m):
                    both = np.sort(np.concatenate([left[0][end_l[row] - n : end_l[row]], right[0][end_r[row] - m : end_r[row]]]))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    yes[row] = 100 * shared >= percent * (n + m - shared)
            yield batch.select(["a", "b"]).filter(pa.array(yes))

    own = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).join(pairs.select(c).distinct(), c, "left_semi")
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(confirmed, "a long, b long")


def _candidates(described: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, rep) of the buckets that hold several classes; copies, by their place or else id and hash, stay out, as their class is there.

    Classes that are much alike share many bands. Of buckets with the same members, told by their
    count and two sums of mixed ids, one is kept.
    """
    whole = described.filter("n_shingles > 0 and doc_id is not null")
    if "place" in copies.columns:  # bands do not move
        stands = marked(whole.select("doc_id", "bands", "place"), F.col("place"), copies.select("place"), "copy").filter("not copy")
    else:
        stands = whole.join(copies.select(F.col("a").alias("doc_id"), "high", "low"), ["doc_id", "high", "low"], "left_anti")
    spread = stands.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")  # most keys have one class: count them before anything else of them moves
    shared = keep(shared, "shared")
    spread = keep(spread.join(shared, "key", "left_semi"), "spread")
    sums = [F.sum(F.shiftright(F.xxhash64("rep", F.lit(seed)), 32)).alias(f"sum{seed}") for seed in (1, 2)]
    several = spread.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n"), *sums).filter("first <> last")
    different = several.groupBy("first", "last", "n", "sum1", "sum2").agg(F.min("key").alias("key"), F.count("*").alias("bands"))
    return spread.join(different.select("key", "bands"), "key")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id linked), kept."""
    described = keep(describe(docs, k, rows_per_band).withColumn("place", F.monotonically_increasing_id()), "described")
    whole = described.filter("n_shingles > 0 and doc_id is not null")
    classes = whole.groupBy("n_shingles", "high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = whole.join(classes, ["n_shingles", "high", "low"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "place")
    copies = keep(copies, "copies")
    members, n = keep_counted(_candidates(described, copies), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps, many = keep_counted(members.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    texts = keep(perhaps(texts, "doc_id", reps, many), "texts")
    sketched = keep(perhaps(described.select("doc_id", "n_shingles", "signature"), "doc_id", reps, many), "sketched")  # all that later rounds read

    # first round: each class against the centre that it shares most buckets with
    star = members.groupBy("key").agg(F.min("rep").alias("b"))
    tries = members.join(star, "key").filter("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.sum("bands").alias("n"))
    pairs = tries.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    tested = [pairs]
    links = keep(confirm(keep(_likely(pairs, sketched, percent), "likely"), texts, k, percent), "links")
    found = components(copies.select("a", "b").union(links), "near")

    # later rounds: likely pairs between components of a bucket
    most, first = 2, True
    while n:
        placed = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        placed, n = keep_counted(placed.join(mixed, "key").distinct(), "open")
        if not n:
            break
        if first:
            placed, first = keep(_gathered(placed), "gathered"), False
        likely = keep(_between_components(placed, sketched, percent, most), "likely")
        pairs = likely.select("a", "b").distinct()
        pairs, new = keep_counted(pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti"), "pairs")
        tested.append(pairs)
        if new:
            links, new = keep_counted(confirm(pairs, texts, k, percent), "links")
        if new:
            found = merge(found, links, "near")
        left = likely.select(F.col("unfinished").alias("key")).filter("key is not null").distinct()
        members, most = placed.select("key", "rep").join(left, "key", "left_semi"), 16 * most

    rows = described.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
