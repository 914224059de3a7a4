"""A cuckoo filter over 64-bit keys in numpy, with bulk insertion, lookup and deletion.

It has a power of two of buckets with four 16-bit fingerprints each.  A key may
lie in two buckets; each follows from the other and the fingerprint, so keys of
equal fingerprint and bucket are interchangeable and deletions are safe.
"""

from __future__ import annotations

import numpy as np

from .kernels import mix

SLOTS = 4
_MAGIC = np.uint32(0x5BD1E995)


class CuckooFilter:
    """No false negatives for keys that were added and not dropped.  Keys must be distinct when added."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @staticmethod
    def sized(keys: int) -> CuckooFilter:
        """Empty, with room for ``keys`` at a load of at most 0.8."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return CuckooFilter(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @staticmethod
    def build(keys: np.ndarray) -> CuckooFilter:
        room = max(1, len(keys))
        while True:
            made = CuckooFilter.sized(room)
            if made.add(keys):
                return made
            room *= 2

    @staticmethod
    def load(data: bytes) -> CuckooFilter:
        return CuckooFilter(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        finger = np.maximum((h >> np.uint64(48)).astype(np.uint16), np.uint16(1))
        return finger, (h & np.uint64(len(self.slots) - 1)).astype(np.uint32)

    def _other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        return bucket ^ ((finger.astype(np.uint32) * _MAGIC) & np.uint32(len(self.slots) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        finger, at = self._places(keys)
        other = self._other(at, finger)
        return ((self.slots[at] == finger[:, None]) | (self.slots[other] == finger[:, None])).any(axis=1)

    def add(self, keys: np.ndarray, rounds: int = 300) -> bool:
        """Insert keys in bulk; if they don't all fit, the filter stays as it was and the result is False."""
        if len(self) + len(keys) > 0.93 * self.slots.size:
            return False
        slots = self.slots.copy()
        finger, at = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(rounds):
            if len(at) == 0:
                break
            by = np.argsort(at, kind="stable")
            at, finger = at[by], finger[by]
            rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            taken = slots[at] != 0
            fits = rank < SLOTS - taken.sum(axis=1)
            slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            slots[at[fits], slot[fits]] = finger[fits]
            at, finger = at[~fits], finger[~fits]
            if turn % 2 and len(at):
                first = np.concatenate(([True], at[1:] != at[:-1]))
                victim = rng.integers(0, SLOTS, int(first.sum()))
                evicted = slots[at[first], victim]
                slots[at[first], victim] = finger[first]
                finger[first] = evicted
            at = self._other(at, finger)
        if len(at):
            return False
        self.slots = slots
        return True

    def drop(self, keys: np.ndarray) -> None:
        """Remove keys that were added, each once."""
        finger, at = self._places(keys)
        for _ in range(2):
            by = np.lexsort((finger, at))
            finger, at = finger[by], at[by]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (finger[1:] != finger[:-1])
            start = np.flatnonzero(new)
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            differs = self.slots[at] != finger[:, None]
            fits = rank < SLOTS - differs.sum(axis=1)
            slot = np.argsort(differs, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.slots[at[fits], slot[fits]] = 0
            at, finger = at[~fits], finger[~fits]
            at = self._other(at, finger)
