"""Token ids of documents in files of directly addressable codes.

A file is a table of blocks, in ascending order of documents. A block holds the ids of some whole
documents as one payload, see ``pack``: ids are cut into bytes; level 0 has the lowest byte of every
id, level 1 the next byte of those ids that go on, and so forth. A bitmap of each level says which
ids go on, and a rank directory counts the set bits before each 512. So id i is found from its
place alone, without decoding what lies before it; a run of ids takes one slice per level.

Blocks are rows that Spark's writer commits, so a lost executor leaves no half-written file and any
store that Spark writes to will do.

Nulls and odd rows: a null or empty text has just the end id. Documents are ordered by identifier,
null first, then by text; repeated rows are kept and follow each other. An empty table gives no
block. A text longer than a block is a block alone. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseweave.llm import words as W
from caseweave.llm.stretches import Stretches

RANK_BITS = 512
BLOCK_TOKENS = 1 << 18
BLOCKS = "shard int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Ids as chunk levels: for each level its count, its bytes, its bitmap and its rank directory."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        goes_on = rest > 255
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + np.packbits(goes_on, bitorder="little").tobytes() + directory.tobytes())
        rest = rest[goes_on] >> 8
        if not len(rest):
            return struct.pack("<I", len(levels)) + b"".join(levels)


class Packed:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        (n,), at = struct.unpack_from("<I", payload), 4
        self.levels = []
        for _ in range(n):
            (count,) = struct.unpack_from("<Q", payload, at)
            sizes, parts = (count, -(-count // 8), 4 * (-(-count // RANK_BITS) + 1)), []
            at += 8
            for size in sizes:
                parts.append(np.frombuffer(payload, np.uint8, size, at))
                at += size
            self.levels.append((parts[0], parts[1], parts[2].view("<u4") if parts[2].flags.aligned else np.frombuffer(parts[2].tobytes(), "<u4")))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before place i."""
        whole = i // RANK_BITS
        bits = int.from_bytes(bitmap[whole * RANK_BITS // 8 : -(-i // 8)].tobytes(), "little")
        return int(directory[whole]) + (bits & ((1 << (i - whole * RANK_BITS)) - 1)).bit_count()

    def slice(self, start: int, stop: int) -> np.ndarray:
        return self._level(0, start, stop)

    def _level(self, k: int, start: int, stop: int) -> np.ndarray:
        chunks, bitmap, directory = self.levels[k]
        out = chunks[start:stop].astype(np.uint32)
        first = start // 8
        goes_on = np.unpackbits(bitmap[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
        if goes_on.any():
            out[goes_on] |= self._level(k + 1, self._rank(bitmap, directory, start), self._rank(bitmap, directory, stop)) << 8
        return out


class ByteBpe(Stretches):
    """A byte-level BPE tokenizer of the tokenizers library, asked once for each distinct stretch.

    The pre-tokenizer always begins a new word at a space that a character other than white space
    follows, so a text can be cut there and the ids of its stretches joined (tested against whole
    texts). With ``special`` the file's special strings in a text are their own ids, as the library
    has it by default, and white space before them is a word that no cut may divide; without it they
    are spelled out like other text.
    """

    #: First bytes of what may be white space after a space: no cut there.
    _NO_CUT = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special] if special else []
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.may_cut = np.ones(256, bool)
        self.may_cut[self._NO_CUT] = False
        super().__init__()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & self.may_cut[data[1:]]
        whole = data.tobytes() if self.special else b""
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                cut[max(at - 1, 0)] = False
                at = whole.find(mark, at + len(mark))
        return cut

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        whole = b"".join(stretches)
        marks = [mark for mark in self.special if mark in whole]  # hardly any slice has one
        plain = [b[:1] == b" " and b.count(b" ") == 1 and not (marks and any(mark in b for mark in marks)) for b in stretches]
        simple = [i for i, yes in enumerate(plain) if yes]
        other = [i for i, yes in enumerate(plain) if not yes]
        for at in range(0, len(simple), 2000):
            some = simple[at : at + 2000]
            (ids,) = self._ids([b"".join(stretches[i] for i in some).decode()])
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(some):
                self._learn(keys[some], ids, np.diff(first, append=len(ids)))
            else:
                other += some
        if other:
            found = self._ids([stretches[i].decode() for i in other])
            self._learn(keys[other], np.concatenate(found), np.array([len(x) for x in found]))


_loaded: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer(path: str, special: bool = False) -> ByteBpe:
    """One tokenizer per worker process, with what it has learnt."""
    if (path, special) not in _loaded:
        _loaded[path, special] = ByteBpe(path, special)
    return _loaded[path, special]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_tokens: int = BLOCK_TOKENS, special: bool = False) -> None:
    """Encode whole texts, add ``end_id`` to each, and write the blocks in ascending doc_id order.

    ``special``: special strings of the tokenizer in a text are their own ids.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, block = tokenizer(tokenizer_path, special), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n_held = 0

        def out() -> pa.RecordBatch:
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            one = {"shard": shard, "block": block, "n_tokens": len(ids), "doc_ids": doc_ids, "lengths": sizes.tolist(), "payload": pack(ids)}
            return pa.RecordBatch.from_pylist([one], schema=SCHEMA)

        for batch in W.pieces(batches, most=1 << 20):
            ids, sizes = bpe.encode(*W.text_bytes(batch.column("text")))
            held.append(np.insert(ids, np.cumsum(sizes), end_id))
            lengths.append(sizes + 1)
            doc_ids += batch.column(0).to_pylist()
            n_held += len(held[-1])
            if n_held >= block_tokens:
                yield out()
                block, doc_ids, lengths, held, n_held = block + 1, [], [], [], 0
        if doc_ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)


SCHEMA = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, start): ids before each block. Sums go up by blocks, shards and groups of 1024
    shards, so the one window without a partition sees a row per group of shards."""
    total = F.sum("n").alias("n")
    by_block = blocks.select("shard", "block", (F.col("shard") / 1024).cast("int").alias("big"), F.col("n_tokens").alias("n"))
    by_shard = by_block.groupBy("shard", "big").agg(total)
    by_big = by_shard.groupBy("big").agg(total)

    def before(df: DataFrame, key: str, *within: str) -> DataFrame:
        window = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))

    big = before(by_big, "big").select("big", F.col("before").alias("before_big"))
    shard = before(by_shard, "shard", "big").join(big, "big").select("shard", (F.col("before") + F.col("before_big")).alias("before_shard"))
    return before(by_block, "block", "shard").join(shard, "shard").select("shard", "block", (F.col("before") + F.col("before_shard")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: its id, the ids before it, its count, its checksum."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard, block, _, doc_ids, lengths, payload = (batch.column(k)[row] for k in range(6))
                packed, sizes = Packed(payload.as_py()), np.array(lengths.values, np.int64)
                ends = np.cumsum(sizes)
                ids = packed.slice(0, len(packed)).astype("<u4")
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(sizes, ends, strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(np.full(n, shard.as_py(), np.int32)), pa.array(np.full(n, block.as_py(), np.int32)), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["doc_id", "shard", "block", "within", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(rows, "doc_id long, shard int, block int, within long, n_tokens long, ids_crc32 long")
    return docs.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", "block"
    )


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """The ids of some documents (column ``doc_id``), each sliced out of its block without decoding the rest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, within, length, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = Packed(payload.as_py()).slice(within.as_py(), within.as_py() + length.as_py())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id.as_py()], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, ids, lengths in zip(*(batch.column(k) for k in range(4)), strict=True):
                sizes = np.array(lengths.values, np.int64)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.full(n, shard.as_py(), np.int32)), pa.array(np.full(n, block.as_py(), np.int32)), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)],
                    names=["doc_id", "shard", "block", "within", "length"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(path)
    index = blocks.select("shard", "block", "doc_ids", "lengths").mapInArrow(places, "doc_id long, shard int, block int, within long, length long")
    wanted = index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    found = wanted.join(blocks.select("shard", "block", "payload"), ["shard", "block"])
    return found.select("doc_id", "within", "length", "payload").mapInArrow(rows, "doc_id long, ids array<int>")
