"""Ids of texts from the ids of their stretches, each worked out once.

A tokenizer that always begins anew at certain places can be asked stretch by stretch. Stretches
recur, so a worker process keeps the ids of those it has met, up to ``CACHED`` of them; then it
forgets all and goes on. What a text's ids are does not depend on what is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from caseweave.llm import words as W

CACHED = 1 << 20


class Places:
    """Numbers by 64-bit key: open addressing, many keys at a time."""

    def __init__(self) -> None:
        self.n = 0
        self._sized(1 << 16)

    def _sized(self, size: int) -> None:
        self.keys, self.values, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.uint64(size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        keys = np.maximum(keys, np.uint64(1))  # 0 is an empty slot
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys & self.mask
        while len(open_):
            there = self.keys[slot]
            hit = there == keys
            out[open_[hit]] = self.values[slot[hit]]
            going = ~hit & (there != 0)
            open_, keys, slot = open_[going], keys[going], (slot[going] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, different keys."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old, size = self.keys != 0, len(self.keys)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 2 * self.n > size:
                size *= 2
            self._sized(size)
        keys = np.maximum(keys, np.uint64(1))
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = free & (self.keys[slot] == keys)  # of several that took a slot one has it
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + np.uint64(1)) & self.mask


class Stretches:
    most = CACHED  # stretches that one of these remembers

    def __init__(self) -> None:
        self.code = W.alphabet(b"").code
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, known = len(keys), self.place.n
        while known + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[known : known + n] = self.used + np.cumsum(sizes) - sizes
        self.size[known : known + n] = sizes
        self.used += len(ids)
        self.place.add(keys, np.arange(known, known + n))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte and the end: does a stretch begin there? Beginnings of texts are added."""
        raise NotImplementedError

    def ask(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        """Learn the ids of new stretches."""
        raise NotImplementedError

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        n = len(offsets) - 1
        cut = self.cuts(data)
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        end = np.append(start[1:], len(data))
        owner = np.searchsorted(offsets, start, side="right") - 1
        codes, keys = pd.factorize(W.hash_spans(data, start, end, self.code))
        if self.place.n + len(keys) > self.most:
            self._forget()
        place = self.place.find(keys)
        if (place < 0).any():
            example = np.zeros(len(keys), np.int64)
            example[codes] = np.arange(len(codes))
            new = np.flatnonzero(place < 0)
            whole = data.tobytes()
            self.ask(keys[new], [whole[a:b] for a, b in zip(start[example[new]].tolist(), end[example[new]].tolist(), strict=True)])
            place = self.place.find(keys)
        sizes = self.size[place][codes]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[place][codes] - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
