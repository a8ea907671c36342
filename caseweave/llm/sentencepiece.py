"""SentencePiece encoding and decoding by suffix-array matching (BPE models with byte fallback).

A space and U+2581 are the same mark; one is put before every text that is not empty. No piece has
a mark after another character, and a line break is in no piece, so texts are cut there, and each
distinct stretch is encoded once per worker. The new stretches of a batch are indexed together:

1. their characters, as numbers, are sorted by suffix;
2. every piece is searched by bisection: its occurrences are one range of the suffix array;
3. the occurrences are edges over the text, put in order of position (a row per position, a column
   per length);
4. relaxation: symbols begin as characters; in each round every stretch takes the best edge that
   spans exactly two neighbouring symbols, by the piece's score, then from the left, until no edge
   does. All stretches take their steps together, as array operations; a stretch of over
   ``LONG`` characters takes its steps with a heap.

What is then no piece is written in bytes. Decoding joins the pieces' bytes and takes the first mark off.

Nulls and odd rows: a null or empty text has no ids and decodes to the empty text; U+2581 decodes as
a space; repeated rows are encoded each by themselves; a null doc_id is passed through; empty tables
give empty results. Columns of the documents stay as they are; the new columns must not be among them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm import words as W
from caseweave.llm.stretches import Stretches

MARK = "▁"
LONG = 64
INDEX_CHARS = 1 << 18  # characters of stretches that are indexed together
KEY = 8  # characters that suffixes are sorted by; longer pieces are compared to their end
UNKNOWN, GAP = 0xFFFF, 0
NEVER = np.iinfo(np.int64).max


def _bounds(keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Bisection of many wanted keys at once, each within its own range [low, high) of sorted keys."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        there = keys[np.minimum(middle, len(keys) - 1)]
        right = open_ & ((there <= wanted) if after else (there < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


class Pieces(Stretches):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.uint32)
        text: dict[int, str] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text[i] = piece.replace(MARK, " ")
                self.bytes_of[i] = text[i].encode()
        if any(b != " " and a == " " for p in text.values() for b, a in zip(p, p[1:], strict=False)) or any("\n" in p for p in text.values()):
            raise ValueError("the model has pieces across marks or lines")
        letters = sorted({c for p in text.values() for c in p})
        self.letter = np.full(0x110000, UNKNOWN, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(0x10000, -1, np.int64)
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.longest = max(map(len, text.values()))
        for i, piece in text.items():
            if len(piece) == 1:
                self.single[self.letter[ord(piece)]] = i
        self.ids = np.array([i for i, p in text.items() if len(p) > 1])
        self.lengths = np.array([len(text[i]) for i in self.ids])
        self.letters = np.full((len(self.ids), max(self.longest, 2 * KEY)), GAP, np.uint16)
        for row, i in enumerate(self.ids):
            self.letters[row, : len(text[i])] = self.letter[[ord(c) for c in text[i]]]
        # the ranges that a piece stands for: its letters, then the least or the greatest that may follow
        filled = np.arange(KEY)[None, :] < self.lengths[:, None]
        self.low = self._keys(np.where(filled, self.letters[:, :KEY], 0))
        self.high = self._keys(np.where(filled, self.letters[:, :KEY], 0xFFFF))
        super().__init__()

    @staticmethod
    def _keys(columns: np.ndarray) -> list[np.ndarray]:
        """Rows of KEY letters as two numbers that sort alike."""
        wide = columns.astype(np.uint64)
        return [(wide[:, a] << W.U64(48)) | (wide[:, a + 1] << W.U64(32)) | (wide[:, a + 2] << W.U64(16)) | wide[:, a + 3] for a in (0, 4)]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        mark, line = data == 0x20, data == 0x0A
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = line
        cut[1:-1] |= mark[1:] & ~mark[:-1]
        cut[1:] |= line
        return cut

    def ask(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        texts = [s.decode() for s in stretches]
        at = 0
        while at < len(texts):
            stop, total = at, 0
            while stop < len(texts) and (stop == at or total + len(texts[stop]) < INDEX_CHARS):
                total += len(texts[stop]) + 1
                stop += 1
            self._learn(keys[at:stop], *self._encode(texts[at:stop]))
            at = stop

    def _edges(self, letters: np.ndarray) -> np.ndarray:
        """(position, length) -> piece id + 1, from the ranges of the suffix array."""
        n = len(letters)
        padded = np.concatenate([letters, np.zeros(max(self.longest, KEY), np.uint16)])
        first, second = self._keys(np.lib.stride_tricks.sliding_window_view(padded, KEY)[:n])
        suffixes = np.lexsort((second, first))
        first, second = first[suffixes], second[suffixes]
        low, high = np.searchsorted(first, self.low[0], "left"), np.searchsorted(first, self.high[0], "right")
        some = np.flatnonzero((low < high) & (self.lengths > KEY // 2))
        a, b = low[some], high[some]
        low[some] = _bounds(second, a, b, self.low[1][some], after=False)
        high[some] = _bounds(second, a, b, self.high[1][some], after=True)
        found = np.flatnonzero(low < high)
        count = high[found] - low[found]
        piece = np.repeat(found, count)
        place = suffixes[np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        long = np.flatnonzero(self.lengths[piece] > KEY)
        if len(long):
            rest = np.arange(KEY, self.longest)
            same = (padded[place[long][:, None] + rest] == self.letters[piece[long]][:, KEY : self.longest]) | (rest >= self.lengths[piece[long]][:, None])
            wrong = long[~same.all(axis=1)]
            piece, place = np.delete(piece, wrong), np.delete(place, wrong)
        table = np.zeros((n, self.longest + 1), np.uint16 if len(self.bytes_of) < 0xFFFF else np.uint32)
        table[place, self.lengths[piece]] = self.ids[piece] + 1
        return table

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        chars = np.array([len(t) for t in texts])
        ends = np.cumsum(chars + 1)
        begins = ends - chars - 1
        letters = self.letter[points].copy()
        letters[ends - 1] = GAP
        edges = self._edges(letters)
        size = np.ones(len(points), np.int64)  # of the symbol that begins here; 0: none does
        size[ends - 1] = 0
        self._relax(edges, size, begins[chars <= LONG], chars[chars <= LONG])
        for s, n in zip(begins[chars > LONG], chars[chars > LONG], strict=True):
            self._relax_long(edges, size, int(s), int(n))
        starts = np.flatnonzero(size)
        width = size[starts]
        ids = np.where(width > 1, edges[starts, width].astype(np.int64) - 1, self.single[letters[starts]])
        bad = np.flatnonzero(ids < 0)
        counts = np.ones(len(ids), np.int64)
        if len(bad):
            spelled = [chr(points[starts[k]]).encode() for k in bad]
            counts[bad] = [len(b) for b in spelled]
            ids = np.repeat(ids, counts)
            ids[ids < 0] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        owner = np.searchsorted(ends, starts, side="right")
        return ids.astype(np.uint32), np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)

    def _relax(self, edges: np.ndarray, size: np.ndarray, begins: np.ndarray, chars: np.ndarray) -> None:
        at = np.repeat(begins - np.cumsum(chars) + chars, chars) + np.arange(chars.sum())  # starts of the open stretches' symbols
        owner = np.repeat(np.arange(len(chars)), chars)
        while len(at) > 1:
            span = size[at[:-1]] + size[at[1:]]
            near = (owner[:-1] == owner[1:]) & (span <= self.longest)
            piece = np.where(near, edges[at[:-1], np.minimum(span, self.longest)], 0).astype(np.int64)
            worth = np.where(piece > 0, (self.rank[piece - 1] << 32) + np.arange(len(piece)), NEVER)
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(np.append(worth, NEVER), heads)
            going = best < NEVER
            left = best[going] & 0xFFFFFFFF
            size[at[left]] += size[at[left + 1]]
            size[at[left + 1]] = 0
            stays = np.repeat(going, np.diff(np.append(heads, len(at))))
            stays[left + 1] = False
            at, owner = at[stays], owner[stays]

    def _relax_long(self, edges: np.ndarray, size: np.ndarray, begin: int, n: int) -> None:
        end = begin + n
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        length = [1] * n
        waiting: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and length[i] + length[j] <= self.longest and (piece := int(edges[begin + i, length[i] + length[j]])):
                heapq.heappush(waiting, (int(self.rank[piece - 1]), i, length[i] + length[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, span = heapq.heappop(waiting)
            j = after[i]
            if not length[i] or j >= n or length[i] + length[j] != span:
                continue
            length[i], length[j], after[i] = span, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        size[begin:end] = length

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text, its first mark taken off."""
        joined = [self.bytes_of[i] for i in ids.tolist()]
        ends = np.cumsum(sizes).tolist()
        return [b"".join(joined[e - n : e])[1:] for e, n in zip(ends, sizes.tolist(), strict=True)]


_loaded: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One model per worker process, with what it has learnt."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _marked(column: pa.Array) -> pa.Array:
    """Texts with one kind of mark, and one more in front of those that are not empty."""
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    return pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)), column)


def encode(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """The documents with the ids of their whole texts as array<int>."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text_column, most=1 << 20):
            ids, sizes = model(path).encode(*W.text_bytes(_marked(batch.column(text_column))))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids_column])
            del batch, ids, sizes, lists
            W.give_back()  # the index of a slice is many times its text

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    return docs.mapInArrow(encoded, T.StructType([*fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """The rows with the texts that their ids stand for; bytes that are no UTF-8 become U+FFFD."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                lists = pc.fill_null(some.column(ids_column), [])
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [b.decode(errors="replace") for b in model(path).decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), sizes)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_column])
                del some, lists, sizes, texts
            del batch
            W.give_back()

    fields = [T.StructField(f.name, f.dataType) for f in rows.schema]
    return rows.mapInArrow(decoded, T.StructType([*fields, T.StructField(text_column, T.StringType())]))


def report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, a hash of the ids, and whether they decode to its text."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == text).alias("round_trip"))
