"""A cuckoo filter held in a numpy array: insert, delete and test many keys at once."""

from __future__ import annotations

import math

import numpy as np

SLOTS = 4
FILL = 0.84
MAX_KICKS = 500
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; 0 marks a free slot.

    The second bucket of a fingerprint is the first one xor a hash of the
    fingerprint, so an entry can move or go without its key.  A filter that gets too
    full is reported (``insert`` returns False) and its owner builds a larger one.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(2, math.ceil(math.log2(max(1, n) / (SLOTS * FILL)))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray):
        mixed = _mixed(keys.astype(np.uint64))
        prints = (mixed >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        first = (mixed & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        jump = _mixed(np.atleast_1d(prints).astype(np.uint64)) & np.uint64(self.buckets - 1)
        return bucket ^ jump.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys, one entry each; False when the filter is too full."""
        prints, first, second = self._places(keys)
        rng = np.random.default_rng(1)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            if self._put(a, p) or self._put(b, p):
                continue
            at = b
            for _ in range(MAX_KICKS):
                slot = int(rng.integers(SLOTS))
                p, self.table[at, slot] = int(self.table[at, slot]), p
                at = int(self._other(at, np.uint32(p))[0])
                if self._put(at, p):
                    break
            else:
                return False
        return True

    def _put(self, bucket: int, fingerprint: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = fingerprint
        return len(free) > 0

    def delete(self, keys: np.ndarray) -> None:
        """Take out one entry of each key; the keys must have been inserted."""
        prints, first, second = self._places(keys)
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == p)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def built(keys: np.ndarray) -> CuckooFilter:
    """A filter of the given distinct keys."""
    room = max(8, len(keys))
    while True:
        out = CuckooFilter.for_keys(room)
        if out.insert(keys):
            return out
        room *= 2
