"""Minimal perfect hashing of distinct 64-bit keys by cascading bit arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit mix of unsigned keys."""
    x = keys.astype(U) + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """Gives each of n keys its own number below n.

    Level by level, the keys left over are hashed to twice as many bits; a bit that one key alone hits is that key's. A key's number is
    the rank of its bit over all levels. ``sizes`` are bits per level, ``bits`` the words of all levels in turn, ``ranks`` the set bits before each word.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Built for distinct unsigned ``keys``."""
        left, sizes, levels = keys.astype(U), [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = (mixed(left, len(sizes)) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels).astype(U) if levels else np.zeros(0, U)
        ones = np.bitwise_count(bits).astype(np.int64)
        return cls(np.array(sizes, np.int64), bits, np.cumsum(ones) - ones)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; of a key that was not built in, any number or -1, so compare the key kept at that number."""
        keys = keys.astype(U)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mixed(keys[left], level) % U(size)
            word = self.starts[level] + (at >> U(6)).astype(np.int64)
            low, bits = at & U(63), self.bits[word]
            hit = (bits >> low) & U(1) == 1
            below = np.bitwise_count(bits & ((U(1) << low) - U(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left = left[~hit]
        return out

    def flat(self) -> np.ndarray:
        """All parts in one array, for a file."""
        return np.concatenate([[len(self.sizes)], self.sizes, self.bits.view(np.int64), self.ranks]).astype(np.int64)

    @classmethod
    def from_flat(cls, a: np.ndarray) -> PerfectHash:
        n = int(a[0])
        words = (len(a) - 1 - n) // 2
        return cls(np.asarray(a[1:n + 1]), a[n + 1:n + 1 + words].view(U), a[n + 1 + words:])
