"""Cuckoo filters of 128-bit keys: four 32-bit fingerprints a bucket, with deletion."""

from __future__ import annotations

import numpy as np

from .words import mix


class CuckooFilter:
    """``slots[bucket, 0..3]`` holds fingerprints, 0 where empty. A key (two int64) has two possible buckets, each
    of which follows from the other and the fingerprint, so that entries can be moved and deleted without keys.
    Only keys that were inserted may be deleted."""

    def __init__(self, capacity: int = 0, slots: np.ndarray | None = None):
        if slots is None:
            buckets = 4
            while buckets * 4 * 0.85 < capacity:
                buckets *= 2
            slots = np.zeros((buckets, 4), np.uint32)
        self.slots = slots

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(data, np.uint32).reshape(-1, 4).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = (b.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        marks[marks == 0] = 1
        mask = np.uint64(len(self.slots) - 1)
        first = a.view(np.uint64) & mask
        return marks, first, first ^ (mix(marks.astype(np.uint64)) & mask)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(a, b)
        return (self.slots[first] == marks[:, None]).any(1) | (self.slots[second] == marks[:, None]).any(1)

    def insert(self, a: np.ndarray, b: np.ndarray) -> bool:
        """False if the filter got too full; its content is then of no use and must be built anew, larger. All keys go
        in rounds, of which each puts one mark into a bucket; marks that find none free wait, and in the end push
        another out, which goes to its other bucket."""
        marks, bucket, second = self._places(a, b)
        fresh, mask, slots = np.ones(len(marks), bool), np.uint64(len(self.slots) - 1), self.slots
        best, since, turn = len(marks), 0, 0
        while len(marks):
            _, one = np.unique(bucket, return_index=True)
            free = slots[bucket[one]] == 0
            some = free.any(1)
            put = one[some]
            slots[bucket[put], free[some].argmax(1)] = marks[put]
            stuck = one[~some]
            again = stuck[fresh[stuck]]
            bucket[again], fresh[again] = second[again], False
            out = stuck[~np.isin(stuck, again)]
            at = (bucket[out].astype(np.int64) + turn) % 4
            pushed = slots[bucket[out], at].copy()
            slots[bucket[out], at] = marks[out]
            marks[out] = pushed
            bucket[out] ^= mix(pushed.astype(np.uint64)) & mask
            left = np.ones(len(marks), bool)
            left[put] = False
            marks, bucket, second, fresh = marks[left], bucket[left], second[left], fresh[left]
            turn, since = turn + 1, since + 1
            if len(marks) < best:
                best, since = len(marks), 0
            if since > 500:
                return False
        return True

    def delete(self, a: np.ndarray, b: np.ndarray) -> None:
        """One mark of each key, from its first bucket or else from its second."""
        marks, first, second = self._places(a, b)
        missed = self._remove(marks, first)
        self._remove(marks[missed], second[missed])

    def _remove(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Takes each mark out of its bucket once; the places of the marks that weren't there."""
        left, missed = np.arange(len(marks)), [np.empty(0, np.int64)]
        while len(left):
            _, one = np.unique(bucket[left], return_index=True)
            now = left[one]
            found = self.slots[bucket[now]] == marks[now, None]
            some = found.any(1)
            self.slots[bucket[now[some]], found[some].argmax(1)] = 0
            missed.append(now[~some])
            left = np.delete(left, one)
        return np.concatenate(missed)
