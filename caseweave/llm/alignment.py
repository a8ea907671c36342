"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, counted over a corpus.

Both tokenizers spell a space and the text. Where a token of each ends, the text is cut into groups;
a pair of tokens with a byte in common is a link. The links of a document are the stretches between
neighbouring ends of either side: each lies in one token of the one and one token of the other.

An id pair's count is the number of documents that have it linked. Counting is external:

1. Tasks write pair-document records in runs of bounded size: sorted by (first id, second id,
   document), radix-partitioned by the first id, and packed with zstd. A run is a row of the runs
   table; the pairs of each part with their documents in this run are rows of their own, a *node*.
2. The nodes of a part are merged ``FAN`` at a time by a heap on the first id, until one group of
   nodes is left. Pairs are added up before the next merge, so a frequent id costs a merge no more
   than the different pairs it has, however many documents hold it.
3. The last merge goes by first id, so it knows the highest count of an id when it leaves it. Counts
   and whether they are the highest go back the way that the pairs came, down to each run, where they
   are added up per document.

Everything between is a table in the shared folder; no task sees more than FAN nodes of one part, or
one run. A run holds whole documents, so it is as long as the longest one at least.

Nulls and odd rows: a text that is null, empty, or that one of the two does not spell byte by byte
(for pieces: one with U+2581) has no tokens: all zeros and no groups; a null doc_id is passed through;
repeated rows are documents of their own; an empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm import sentencepiece, tokens
from caseweave.llm import words as W
from caseweave.storage import keep

PARTS = 32  # radix partitions of the first ids
FAN = 256  # nodes that one merge takes
RUN_RECORDS = 1 << 21  # records that end a run
RUN_DOCS = 1 << 18
_DOC_BITS = W.U64(26)
CACHED = 1 << 18  # stretches that each tokenizer of a worker remembers


# --- packing ---------------------------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, in planes of bytes, packed with zstd."""
    wide = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)
    planes = next((n for n in range(8, 0, -1) if wide[:, n - 1].any()), 0)
    body = np.ascontiguousarray(wide[:, :planes].T).tobytes()
    return len(numbers).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:]), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if n and len(body):
        out[:, : len(body) // n] = body.reshape(-1, n).T
    return out.reshape(-1).view("<u8").astype(W.U64)


def pack_rising(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=W.U64(0)))


def unpack_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=W.U64)


# --- the two sides ---------------------------------------------------------------------------------


class Side:
    """A tokenizer with the bytes of each of its ids."""

    def __init__(self, path: str):
        self.pieces = not path.endswith(".json")
        if self.pieces:
            self.model = sentencepiece.Pieces(path)
            spelled = self.model.bytes_of
        else:
            self.model = tokens.ByteBpe(path)
            shown = _byte_letters()
            spelled = [b""] * len(self.model.opens)
            for token, i in self.model.tokenizer.get_vocab().items():
                spelled[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.model.most = CACHED
        self.size = np.array([len(b) for b in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spaced texts in a row, and how many each has."""
        if self.pieces and pc.any(pc.match_substring(texts, sentencepiece.MARK)).as_py():
            texts = pc.replace_substring(texts, sentencepiece.MARK, " ")
        return self.model.encode(*W.text_bytes(texts))

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: do its tokens' bytes give it?"""
        n, sizes = len(counts), np.diff(offsets)
        width = self.size[ids]
        owner = np.repeat(np.arange(n), counts)
        same = np.bincount(owner, weights=width, minlength=n).astype(np.int64) == sizes
        if not same.all():
            stay = same[owner]
            ids, width, data = ids[stay], width[stay], data[np.repeat(same, sizes)]
        ends = np.cumsum(width)
        spelled = self.flat[np.repeat(self.begin[ids] - ends + width, width) + np.arange(len(data))]
        wrong = np.flatnonzero(spelled != data)
        if len(wrong):
            where = np.flatnonzero(same)
            same[where[np.searchsorted(np.cumsum(sizes[where]), wrong, side="right")]] = False
        return same


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(hidden)}


@cache
def side(path: str) -> Side:
    """One per worker process, with what it has learnt."""
    return Side(path)


# --- one slice of texts ----------------------------------------------------------------------------


class Aligned(NamedTuple):
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    link_doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _written(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each with the byte that comes after it, and where each begins."""
    digits = np.ones(len(ids), np.int64)
    most = 10
    while (more := ids >= most).any():
        digits += more
        most *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    rest, left = ids.astype(np.int64), np.arange(len(ids))
    last = ends - 2
    while len(left):
        out[last[left]] = 48 + rest[left] % 10
        rest[left] //= 10
        last[left] -= 1
        left = left[rest[left] > 0]
    out[ends - 1] = after
    return out, ends - digits - 1


def _ends_of(numbers: np.ndarray) -> np.ndarray:
    """Where a row of equal numbers ends."""
    return np.append(numbers[1:] != numbers[:-1], np.ones(min(len(numbers), 1), bool))


def align_slice(texts: pa.Array, a: Side, b: Side) -> Aligned:
    """Groups and links of some texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    spaced = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), texts)
    data, offsets = W.text_bytes(spaced)
    n = len(offsets) - 1
    (ids_a, n_a), (ids_b, n_b) = a.encode(spaced), b.encode(spaced)
    good = (np.diff(offsets) > 0) & a.spells(ids_a, n_a, data, offsets) & b.spells(ids_b, n_b, data, offsets)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    owner_a, owner_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    length = int(end_a[-1]) if len(end_a) else 0
    is_a, is_b = np.zeros(length + 1, bool), np.zeros(length + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    before_a, before_b, cuts = (np.cumsum(x, dtype=np.int64) for x in (is_a, is_b, is_a & is_b))
    # links: one for each end of either side
    end = np.flatnonzero(is_a | is_b)
    at_a, at_b = before_a[end - 1], before_b[end - 1]
    link_doc = owner_a[at_a]
    # groups: all tokens in the order they are written in
    group_a, group_b = cuts[end_a - 1], cuts[end_b - 1]
    many = int(cuts[-1]) if length else 0
    in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    ids, after = np.empty(len(ids_a) + len(ids_b), np.uint32), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    after[place_a[_ends_of(group_a)]], after[place_b[_ends_of(group_b)]] = ord("|"), ord(";")
    written, begins = _written(ids, after)
    begins, total = np.append(begins, len(written)), np.cumsum(n_a + n_b)
    whole = written.tobytes()
    groups = [whole[begins[t - k] : begins[t] - 1] if k else b"" for t, k in zip(total.tolist(), (n_a + n_b).tolist(), strict=True)]
    first = np.flatnonzero(is_a & is_b)
    n_groups = np.bincount(owner_a[before_a[first - 1]], minlength=n)
    return Aligned(n_a, n_b, n_groups, np.bincount(link_doc, minlength=n), groups, link_doc, ids_a[at_a], ids_b[at_b])


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the groups of each text as ``a1,a2|b1;a3|b2,b3``, ids of both sides in order."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            texts = [g.decode() for g in align_slice(batch.column("text"), side(path_a), side(path_b)).groups]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, groups string")


# --- runs ------------------------------------------------------------------------------------------

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
RUNS = "run long, part int, pairs binary, counts binary, records array<binary>, doc_ids array<long>, " + "".join(f"{m} array<long>, " for m in MEASURES) + "digests array<string>"


def _radix(first: np.ndarray) -> np.ndarray:
    return (W.mix(first.astype(W.U64)) % W.U64(PARTS)).astype(np.int64)


def _distinct(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, with their times added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(times[order], heads) if len(keys) else times


def write_runs(docs: DataFrame, path_a: str, path_b: str, most_docs: int = RUN_DOCS) -> DataFrame:
    """The runs table: a row per run (part -1) with its records and documents, a node per run and part."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, task, made = side(path_a), side(path_b), TaskContext.get().partitionId(), 0
        second = W.U64(len(b.size))
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        doc_ids: list = []
        measures: dict[str, list] = {m: [] for m in MEASURES}
        digests: list[str] = []

        def out() -> pa.RecordBatch:
            run = (task << 24) + made
            all_keys, all_times = _distinct(np.concatenate(keys), np.concatenate(times))
            pairs, at = all_keys >> _DOC_BITS, (all_keys & ((W.U64(1) << _DOC_BITS) - W.U64(1)))
            part_of = _radix(pairs // second)
            rows, records = [], []
            for part in range(PARTS):
                mine = np.flatnonzero(part_of == part)
                pair, doc = pairs[mine], at[mine]
                heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else mine
                rows.append({"run": run, "part": part, "pairs": pack_rising(pair[heads]), "counts": pack(np.diff(heads, append=len(pair)))})
                steps = np.diff(doc, prepend=W.U64(0))
                steps[heads] = doc[heads]  # documents rise within a pair
                records += [pack(np.diff(heads, append=len(pair))), pack(steps), pack(all_times[mine])]
            rows.append({"run": run, "part": -1, "records": records, "doc_ids": doc_ids, "digests": digests} | measures)
            return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

        held = 0
        for batch in W.pieces(batches):
            found = align_slice(batch.column("text"), a, b)
            pair = found.link_a.astype(W.U64) * second + found.link_b
            key, n = _distinct((pair << _DOC_BITS) + (found.link_doc + len(doc_ids)).astype(W.U64), np.ones(len(pair), np.int64))
            keys.append(key)
            times.append(n)
            held += len(key)
            doc_ids += batch.column("doc_id").to_pylist()
            for m in MEASURES:
                measures[m] += getattr(found, m).tolist()
            digests += [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
            if held >= RUN_RECORDS or len(doc_ids) >= most_docs:
                yield out()
                made, held, keys, times, doc_ids, measures, digests = made + 1, 0, [], [], [], {m: [] for m in MEASURES}, []
        if doc_ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(rows.mapInArrow(runs, RUNS), "runs")


_SCHEMA = pa.schema(
    [("run", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("records", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64()))]
    + [(m, pa.list_(pa.int64())) for m in MEASURES]
    + [("digests", pa.list_(pa.string()))]
)


# --- merging ---------------------------------------------------------------------------------------


class _Node(NamedTuple):
    pairs: np.ndarray
    counts: np.ndarray
    heads: np.ndarray  # where each first id begins, and the end


def _by_first_id(nodes: list[_Node], second: int) -> Iterator[tuple[list[tuple[int, slice]], np.ndarray, np.ndarray, np.ndarray]]:
    """A k-way merge by a heap on the first id: who has it and where, its different pairs, their counts, and which pair each entry is."""
    waiting = [(int(node.pairs[0]) // second, k, 0) for k, node in enumerate(nodes) if len(node.pairs)]
    heapq.heapify(waiting)
    while waiting:
        first, having = waiting[0][0], []
        while waiting and waiting[0][0] == first:
            _, k, step = waiting[0]
            node = nodes[k]
            having.append((k, slice(node.heads[step], node.heads[step + 1])))
            if step + 2 < len(node.heads):
                heapq.heapreplace(waiting, (int(node.pairs[node.heads[step + 1]]) // second, k, step + 1))
            else:
                heapq.heappop(waiting)
        pairs, which = np.unique(np.concatenate([nodes[k].pairs[s] for k, s in having]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, which, np.concatenate([nodes[k].counts[s] for k, s in having]))
        yield having, pairs, counts, which


def _nodes(table: pa.Table, second: int) -> list[_Node]:
    nodes = []
    for pairs, counts in zip(table.column("pairs"), table.column("counts"), strict=True):
        pair = unpack_rising(pairs.as_py())
        first = pair // W.U64(second)
        heads = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(pair)) if len(pair) else np.zeros(1, np.int64)
        nodes.append(_Node(pair, unpack(counts.as_py()).astype(np.int64), heads))
    return nodes


NODE = "run long, part int, pairs binary, counts binary"
SETTLED = "run long, part int, pairs binary, counts binary, best binary"


def _combined(nodes: DataFrame, second: int) -> DataFrame:
    """Nodes (run, part, up, pairs, counts) merged into one per (part, up), which is its run."""

    def merged(table: pa.Table) -> pa.Table:
        found = [(pairs, counts) for _, pairs, counts, _ in _by_first_id(_nodes(table, second), second)]
        pairs, counts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, W.U64) for i in (0, 1))
        one = {"run": table.column("up")[0].as_py(), "part": table.column("part")[0].as_py(), "pairs": pack_rising(pairs), "counts": pack(counts)}
        return pa.Table.from_pylist([one], schema=pa.schema([("run", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]))

    return nodes.groupBy("part", "up").applyInArrow(merged, NODE)


_SETTLED = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def _settled(nodes: DataFrame, second: int) -> DataFrame:
    """The last merge: every node gets the counts of its pairs, and whether they are the highest of their first id."""

    def settle(table: pa.Table) -> pa.Table:
        own = _nodes(table, second)
        counts, best = [np.zeros(len(n.pairs), np.int64) for n in own], [np.zeros(len(n.pairs), np.int64) for n in own]
        for having, _, total, which in _by_first_id(own, second):
            high, at = total == total.max(), 0
            for k, where in having:
                mine = which[at : at + where.stop - where.start]
                counts[k][where], best[k][where] = total[mine], high[mine]
                at += where.stop - where.start
        columns = [table.column("run"), table.column("part"), table.column("pairs"), pa.array(map(pack, counts), pa.binary()), pa.array(map(pack, best), pa.binary())]
        return pa.table(columns, schema=_SETTLED)

    return nodes.groupBy("part").applyInArrow(settle, SETTLED)


def _handed_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Counts from the merged nodes to those that they were merged from."""

    def spread(below: pa.Table, over: pa.Table) -> pa.Table:
        pairs, counts, best = (f(over.column(c)[0].as_py()) for f, c in ((unpack_rising, "pairs"), (unpack, "counts"), (unpack, "best")))
        places = [np.searchsorted(pairs, unpack_rising(p.as_py())) for p in below.column("pairs")]
        columns = [below.column("run"), below.column("part"), below.column("pairs"), pa.array([pack(counts[p]) for p in places], pa.binary()), pa.array([pack(best[p]) for p in places], pa.binary())]
        return pa.table(columns, schema=_SETTLED)

    return nodes.groupBy("part", "up").cogroup(above.withColumnRenamed("run", "up").groupBy("part", "up")).applyInArrow(spread, SETTLED)


def settle(runs: DataFrame, path_b: str, fan: int = FAN) -> DataFrame:
    """(run, part, pairs, counts, best): the corpus-wide counts of each run's pairs, in the order of its pairs."""
    second = len(side(path_b).size)
    n = runs.filter("part = -1").count()
    levels = [runs.filter("part >= 0").select("run", "part", "pairs", "counts")]
    while n > fan:
        n = math.ceil(n / fan)
        levels[-1] = levels[-1].withColumn("up", F.pmod(F.xxhash64("run", F.lit(n)), F.lit(n)))
        levels.append(keep(_combined(levels[-1], second), "nodes"))
    found = _settled(levels.pop(), second)
    while levels:
        found = _handed_down(levels.pop(), found)
    return keep(found, "settled")


def pair_counts(settled: DataFrame, path_b: str) -> DataFrame:
    """(a, b, n_docs, best): every linked id pair of the corpus, and whether no other pair of its a has more documents."""
    second = len(side(path_b).size)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts, best in zip(*(batch.column(c) for c in ("pairs", "counts", "best")), strict=True):
                pair = unpack_rising(pairs.as_py()).astype(np.int64)
                columns = [pair // second, pair % second, unpack(counts.as_py()).astype(np.int64), unpack(best.as_py()) > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n_docs", "best"])

    return settled.select("pairs", "counts", "best").mapInArrow(listed, "a long, b long, n_docs long, best boolean").distinct()


REPORT = "doc_id long, " + "".join(f"{m} long, " for m in MEASURES) + "n_best long, count_sum long, groups_sha256 string"


_REPORT = pa.schema([("doc_id", pa.int64()), *[(m, pa.int64()) for m in (*MEASURES, "n_best", "count_sum")], ("groups_sha256", pa.string())])


def report(runs: DataFrame, settled: DataFrame) -> DataFrame:
    """One row per document: its tokens, groups and links, its links that are best for their first id, and the counts of its links added up."""

    def summed(run: pa.Table, parts: pa.Table) -> pa.Table:
        columns = {name: run.column(name)[0].values for name in ("doc_ids", *MEASURES, "digests", "records")}
        n = len(columns["doc_ids"])
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for part, counts, best in zip(*(parts.column(c) for c in ("part", "counts", "best")), strict=True):
            own, steps, times = (unpack(columns["records"][3 * part.as_py() + k].as_py()).astype(np.int64) for k in range(3))
            if not len(own):
                continue
            counts, best = (unpack(x.as_py()).astype(np.int64) for x in (counts, best))
            pair, so_far = np.repeat(np.arange(len(own)), own), np.cumsum(steps)
            heads = np.cumsum(own) - own
            docs = so_far - (so_far[heads] - steps[heads])[pair]
            np.add.at(count_sum, docs, times * counts[pair])
            np.add.at(n_best, docs, times * best[pair])
        return pa.table([columns["doc_ids"], *[columns[m] for m in MEASURES], pa.array(n_best), pa.array(count_sum), columns["digests"]], schema=_REPORT)

    whole = runs.filter("part = -1").drop("part", "pairs", "counts")
    return whole.groupBy("run").cogroup(settled.select("run", "part", "counts", "best").groupBy("run")).applyInArrow(summed, REPORT)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The report of all documents, see ``report``."""
    runs = write_runs(docs, path_a, path_b)
    return report(runs, settle(runs, path_b))
