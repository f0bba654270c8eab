"""Minimal perfect hashes of 64-bit keys (or pairs of them) in numpy.

Keys are dealt to blocks by a hash; a block's hash is a cascade of bit arrays: a key alone at its place in the first array
owns that place, the others go on to a smaller array, until none is left. A key's slot is the number of set bits before its own, so n
keys have the slots 0 to n-1. Any other key finds some slot or none, so the keys themselves are stored by slot and compared.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.6  # places per key of a bit array
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LEVELS = 200


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers for each seed."""
    x = x + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    """keys: (n, 1) or (n, 2)."""
    h = mix(keys[:, 0], 2 * seed)
    return h if keys.shape[1] == 1 else h ^ mix(keys[:, 1], 2 * seed + 1)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (hashed(keys, LEVELS) % np.uint64(blocks)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Sizes of the bit arrays, their bits, and the order of the keys (distinct, n x 1 or n x 2) by slot."""
    left, sizes, bits, order = np.arange(len(keys)), [], [], []
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("a key is there twice")
        m = -(-max(64, int(GAMMA * len(left))) // 64) * 64
        at = (hashed(keys[left], len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        own = np.zeros(m, bool)
        own[at[alone]] = True
        order.append(left[alone][np.argsort(at[alone])])
        sizes.append(m)
        bits.append(np.packbits(own, bitorder="little").tobytes())
        left = left[~alone]
    return sizes, b"".join(bits), np.concatenate(order) if order else left


class PerfectHash:
    """The hash of some blocks' keys, of ``blocks`` in all. Slots follow the blocks in order, from ``first`` on."""

    def __init__(self, rows: list[tuple[int, list[int], bytes, bytes]], blocks: int, width: int, first: int = 0):
        """rows: block, sizes, bits, keys by slot; in order of block."""
        self.blocks, self.first = blocks, first
        self.index = np.full(blocks, -1, np.int32)
        self.index[[r[0] for r in rows]] = np.arange(len(rows))
        depth = max((len(r[1]) for r in rows), default=0)
        self.sizes, self.starts, at = np.zeros((depth, len(rows)), np.uint64), np.zeros((depth, len(rows)), np.int64), 0
        for i, (_, sizes, _, _) in enumerate(rows):
            for j, m in enumerate(sizes):
                self.sizes[j, i], self.starts[j, i] = m, at
                at += m // 64
        self.words = np.frombuffer(b"".join(r[2] for r in rows), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), "<u8").reshape(-1, width)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots counted from 0 within these blocks; -1 for keys that are not stored."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        block = self.index[block_of(keys, self.blocks)]
        todo = np.flatnonzero(block >= 0)
        for j in range(len(self.sizes)):
            size = self.sizes[j][block[todo]]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = (hashed(keys[todo], j) % size).astype(np.int64)
            place = self.starts[j][block[todo]] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            word = self.words[place]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[place[hit]] + below
            todo = todo[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[(self.keys[out[found]] != keys[found]).any(1)]] = -1
        return out
