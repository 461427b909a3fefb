"""Token ids of texts from ids of their segments: a segment that was met before isn't encoded again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lineweave.llm.common import byte_values, prefix_hash, span_hash

#: Segments, and ids of segments, that a worker remembers; beyond that it starts anew.
REMEMBER, REMEMBER_IDS = 1_000_000, 10_000_000


class SegmentEncoder:
    """Ids of segments of a byte buffer, looked up by 64-bit hash in an open-addressed numpy table.

    The caller's segments must be such that the tokenizer never merges across them. encode_new gives the ids of a list of
    segments (bytes) that the table doesn't have.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list]):
        self.encode_new = encode_new
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 16
        self.keys, self.value = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.known, self.used = 0, 0
        self.hash, self.begin, self.size = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.flat = np.zeros(1 << 17, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or the empty slot where it belongs."""
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        todo = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            k = self.keys[at[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
        return at

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        while len(h):
            at = self._find(h)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.value[at[first]] = h[first], v[first]
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, v = h[rest], v[rest]

    def _learn(self, h: np.ndarray, segments: list[bytes]) -> None:
        ids = self.encode_new(segments)
        sizes = np.array([len(x) for x in ids], np.int64)
        n, total = len(h), int(sizes.sum())
        while self.known + n > len(self.hash):
            self.hash, self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.begin, self.size))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.known, self.known + n)
        self.hash[own], self.size[own] = h, sizes
        self.begin[own] = self.used + np.cumsum(sizes) - sizes
        if total:
            self.flat[self.used : self.used + total] = np.concatenate([np.asarray(x, np.uint32) for x in ids])
        value = np.arange(self.known, self.known + n, dtype=np.int32)
        self.known, self.used = self.known + n, self.used + total
        if 2 * self.known > self.slots:
            while 2 * self.known > self.slots:
                self.slots *= 4
            self.keys, self.value = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
            self._place(self.hash[: self.known], np.arange(self.known, dtype=np.int32))
        else:
            self._place(h, value)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """Ids of each text. begin: at which segment each text begins, ending with their number."""
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(begin) - 1)
        if self.known > REMEMBER or self.used > REMEMBER_IDS:
            self.clear()
        h = span_hash(prefix_hash(byte_values(data)), starts, ends)
        h[h == 0] = 1
        at = self._find(h)
        new = np.flatnonzero(self.keys[at] == 0)
        if len(new):
            u, first = np.unique(h[new], return_index=True)
            first = new[first]
            self._learn(u, [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at = self._find(h)
        v = self.value[at]
        size = self.size[v]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.begin[v] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[begin]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
