"""Minimal perfect hash by cascading bit arrays, built and probed in numpy."""

from __future__ import annotations

import pickle

import numpy as np

U = np.uint64
_MAX_LEVELS = 48


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) of x under a seed."""
    x = x ^ U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot in [0, n); other keys get -1 or any slot.

    Level by level, the keys that hash to a place nobody else wants take it and are numbered by
    the rank of their bit; the rest go to the next level. Equal keys never part, so what the last
    level leaves is kept in a sorted list, which keeps the map exact.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 1.6) -> None:
        self.n, self.levels, done, rest = len(keys), [], 0, keys.astype(U)
        while len(rest) and len(self.levels) < _MAX_LEVELS:
            m = (max(64, int(gamma * len(rest))) + 63) // 64 * 64
            at = (mix(rest, len(self.levels)) % U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view(U)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int64) + done
            self.levels.append((m, words, ranks))
            done += int(alone.sum())
            rest = rest[~alone[at]]
        self.left = np.unique(rest)
        self.left_from = done

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, words, ranks) in enumerate(self.levels):
            if not len(todo):
                break
            at = mix(keys[todo], level) % U(m)
            word, bit = (at >> U(6)).astype(np.int64), at & U(63)
            hit = (words[word] >> bit) & U(1) == 1
            below = np.bitwise_count(words[word] & ((U(1) << bit) - U(1))).astype(np.int64)
            out[todo[hit]] = (ranks[word] + below)[hit]
            todo = todo[~hit]
        if len(todo) and len(self.left):
            k = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            out[todo] = np.where(self.left[k] == keys[todo], self.left_from + k, -1)
        return out


class CountShard:
    """One shard: slots by perfect hash, with a 64-bit fingerprint and a count for each slot."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> None:
        self.hash = PerfectHash(h1)
        slot = self.hash.slots(h1)
        self.prints, self.counts = np.zeros(len(h1), U), np.zeros(len(h1), np.int64)
        self.prints[slot], self.counts[slot] = h2.astype(U), counts

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 where a key isn't in the shard."""
        slot = self.hash.slots(h1)
        known = slot >= 0
        out = np.zeros(len(h1), np.int64)
        if len(self.prints):
            at = slot[known]
            out[known] = np.where(self.prints[at] == h2[known].astype(U), self.counts[at], 0)
        return out

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.hash.n, self.hash.levels, self.hash.left, self.hash.left_from, self.prints, self.counts), protocol=5)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountShard:
        self, self_hash = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        self_hash.n, self_hash.levels, self_hash.left, self_hash.left_from, self.prints, self.counts = pickle.loads(blob)
        self.hash = self_hash
        return self
