"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

A task sees its rows as Arrow batches. ``pieces`` cuts them into slices of bounded text size,
``text_bytes`` gives the bytes of a slice, and ``find_words`` the place, the owner and a 64-bit hash
of each word. No Python object is made per word. A separator set holds ASCII bytes only, so cutting
bytes and cutting characters is the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACES = bytes([0x20, *range(0x09, 0x0E)])  # what separates words of the word shingles and the quality rules
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])  # after lower-casing
SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


pa.set_memory_pool(pa.system_memory_pool())  # a worker gives memory back between batches
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


class Alphabet(NamedTuple):
    separator: np.ndarray  # bool by byte
    code: np.ndarray  # random 64-bit number by byte; equal for bytes that count as equal


class Words(NamedTuple):
    start: np.ndarray  # byte places in the slice, ascending
    end: np.ndarray
    doc: np.ndarray  # row of the slice
    hash: np.ndarray


def alphabet(separators: bytes, lower: bool = False) -> Alphabet:
    separator = np.zeros(256, bool)
    separator[list(separators)] = True
    code = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    if lower:
        code[ord("A") : ord("Z") + 1] = code[ord("a") : ord("z") + 1]
        separator[ord("A") : ord("Z") + 1] = separator[ord("a") : ord("z") + 1]
    return Alphabet(separator, code)


def give_back() -> None:
    """Memory that is free goes back to the system, pieces between used ones too; the allocator would keep it for a worker's life."""
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (the finishing steps of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most`` bytes of text each; a longer text is a slice alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
        del batch
        give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each text begins (one entry more); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.cumprod(np.concatenate([[U64(1)], np.full(max(n, 2 * HASH_BYTES), U64(base))]), dtype=U64)
    return _powers[name]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + HASH_BYTES, side="right")))
        low, high = int(start[at]), int(end[stop - 1])
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(code[data[low:high]] * _power("up", _BASE, high - low)[: high - low], out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * _power("down", _INVERSE, high - low + 1)[s]
        at = stop
    return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray, alpha: Alphabet) -> Words:
    """Maximal runs of bytes that are no separators, cut at the ends of texts."""
    inside = ~alpha.separator[data]
    after = np.zeros(len(data) + 1, bool)  # does a word go on from the byte before?
    after[1:] = inside
    after[offsets] = False
    start = np.flatnonzero(inside & ~after[:-1])
    going = np.zeros(len(data), bool)  # does it go on with the next byte?
    going[:-1] = inside[1:]
    ends = offsets[1:]
    going[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~going) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, doc, hash_spans(data, start, end, alpha.code))


def counts_by_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the hash of every run of k words that lies in one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    gram = words.hash[first]
    for j in range(1, k):
        gram = mix(gram * U64(_BASE) + words.hash[first + j])
    return first, gram
