"""A cuckoo filter over 64-bit hashes: 16-bit fingerprints, four slots a bucket, all operations on numpy arrays.

It never denies a key it holds. Deleting is safe for keys that were inserted; the exact tables that back a filter see to
that. Inserting grows the filter when it is too full, for which the caller hands in all keys anew.
"""

from __future__ import annotations

import numpy as np

SLOTS, LOAD, ROUNDS = 4, 0.8, 400
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Full(Exception):
    """The filter has no room for the keys that were to be inserted."""


class CuckooFilter:
    def __init__(self, slots: np.ndarray):
        self.slots = slots  # buckets x SLOTS, uint16; 0 is empty

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys."""
        buckets = 1
        while buckets * SLOTS * LOAD < len(keys):
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            try:
                made.insert(keys)
                return made
            except Full:
                buckets *= 2

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (((mark.astype(np.uint64) * _MIX) >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(keys, np.int64).view(np.uint64) * _MIX
        mark = np.maximum((h >> np.uint64(48)).astype(np.uint16), 1).astype(np.uint16)
        at = (h >> np.uint64(8)).astype(np.int64) & (len(self.slots) - 1)
        return mark, at, self._other(at, mark)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, a, b = self._places(keys)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def _put(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts one fingerprint into each bucket with room; which of them found a place."""
        done = np.zeros(len(at), bool)
        first = np.unique(at, return_index=True)[1]
        free = self.slots[at[first]] == 0
        room = free.any(axis=1)
        chosen = first[room]
        self.slots[at[chosen], free[room].argmax(axis=1)] = mark[chosen]
        done[chosen] = True
        return done

    def insert(self, keys: np.ndarray) -> None:
        mark, at, other = self._places(keys)
        for turn in range(ROUNDS):
            if not len(mark):
                return
            done = self._put(at, mark)
            mark, at, other = mark[~done], at[~done], other[~done]
            done = self._put(other, mark)
            mark, at, other = mark[~done], at[~done], other[~done]
            # Who still has no place pushes one out of a full bucket, which goes on to its other bucket.
            first = np.unique(at, return_index=True)[1]
            first = first[(self.slots[at[first]] != 0).all(axis=1)]
            where, slot = at[first], (first + turn) % SLOTS
            out = self.slots[where, slot].copy()
            self.slots[where, slot] = mark[first]
            mark[first] = out
            at[first] = self._other(where, out)
            other[first] = where
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Takes one fingerprint out for each key. Every key must have been inserted."""
        mark, a, b = self._places(keys)
        for where, other, m in zip(a.tolist(), b.tolist(), mark.tolist()):
            for at in (where, other):
                hit = np.flatnonzero(self.slots[at] == m)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break
