"""A cuckoo filter over 64-bit key hashes that holds up to two copies of a key's fingerprint.

One copy says that a key is held by one document, two that it is held by more. No key that was inserted is missed;
a few others may seem held. Copies can be taken out again.
"""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
#: Share of slots that may be filled before a filter has to be built anew, larger.
FULL = 0.9
KICKS = 500
_HEAD = struct.Struct("<4sIQ")


class FilterFull(Exception):
    """No free slot was found; the filter has to be built anew with more buckets."""


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None, items: int = 0):
        """buckets: a power of two."""
        self.buckets, self.items = buckets, items
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def for_items(cls, items: int) -> CuckooFilter:
        """A filter that holds `items` fingerprints at no more than half its slots, to leave room for growth."""
        return cls(1 << max(4, (2 * max(1, items) - 1).bit_length() - 2))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        magic, buckets, items = _HEAD.unpack_from(data)
        if magic != b"CKF1":
            raise ValueError("not a cuckoo filter")
        return cls(buckets, np.frombuffer(data, np.uint16, buckets * SLOTS, _HEAD.size).reshape(buckets, SLOTS).copy(), items)

    def dump(self) -> bytes:
        return _HEAD.pack(b"CKF1", self.buckets, self.items) + self.table.tobytes()

    def room_for(self, more: int) -> bool:
        return self.items + more <= FULL * SLOTS * self.buckets

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64)
        prints = (h & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((h >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        """The other bucket of a fingerprint; applied twice, it gives the first again."""
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def copies(self, hashes: np.ndarray) -> np.ndarray:
        """Copies of each key's fingerprint: at least as many as were inserted for it, up to two."""
        prints, a, b = self._places(hashes)
        found = (self.table[a] == prints[:, None]).sum(axis=1)
        return found + np.where(a != b, (self.table[b] == prints[:, None]).sum(axis=1), 0)

    def insert(self, hashes: np.ndarray) -> None:
        """One more copy for each hash; raises FilterFull if there is no place."""
        if not self.room_for(len(hashes)):
            raise FilterFull
        prints, a, b = self._places(hashes)
        left = np.arange(len(hashes))
        for side in (a, b):  # most find a free slot in one of their buckets: all at once
            own = side[left]
            order = np.argsort(own, kind="stable")
            left, own = left[order], own[order]
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            free = np.argsort(self.table[own] != 0, axis=1, kind="stable")  # free slots first
            fits = rank < (self.table[own] == 0).sum(axis=1)
            self.table[own[fits], free[fits, rank[fits]]] = prints[left[fits]]
            left = left[~fits]
        for k in left:
            self._kick(int(b[k]), prints[k], np.random.default_rng(int(k)))
        self.items += len(hashes)

    def _kick(self, bucket: int, fingerprint: np.uint16, rng: np.random.Generator) -> None:
        for _ in range(KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fingerprint
                return
            slot = int(rng.integers(SLOTS))
            fingerprint, row[slot] = row[slot], fingerprint
            bucket = int(self._other(np.int64(bucket), fingerprint))
        raise FilterFull

    def delete(self, hashes: np.ndarray) -> None:
        """One copy less for each hash; every hash must have been inserted."""
        for fingerprint, a, b in zip(*self._places(hashes), strict=True):
            row = self.table[a] if fingerprint in self.table[a] else self.table[b]
            row[np.flatnonzero(row == fingerprint)[0]] = 0
        self.items -= len(hashes)
