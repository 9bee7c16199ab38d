"""Minimal perfect hashes with stored keys, built and looked up with NumPy.

A key's 64-bit hash picks a bit on the first level; keys that are alone on their
bit stay there, the others go to the next, smaller level with new positions. The
number of set bits before a key's bit is its slot, so ``n`` keys have the slots
0 to n - 1. Keys that are still together after ``LEVELS`` levels (equal 64-bit
hashes) take the last slots and are found by comparing bytes. A looked-up term
counts as found only if the key stored at its slot equals it byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernel as K

GAMMA = 2.0   # bits of a level per key that reaches it
LEVELS = 40


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((2 * level + 1) * int(K.C3) & 0xFFFFFFFFFFFFFFFF)
    return (K.mix(h + seed) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    sizes: list[int]     # bits of the levels
    words: np.ndarray    # all levels' bits, 64 to a word
    before: np.ndarray   # set bits before each word
    keys: pa.Array       # in slot order
    alone: int           # slots from here on belong to keys without a bit of their own

    @classmethod
    def build(cls, keys: pa.Array) -> PerfectHash:
        """The hash of distinct ``keys`` (a binary column)."""
        h, left = K.column_hashes(keys), np.arange(len(keys))
        sizes, bits, owners = [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(h[left], level, size)
            single = np.bincount(at, minlength=size) == 1
            kept = single[at]
            owners.append(left[kept][np.argsort(at[kept])])
            sizes.append(size)
            bits.append(single)
            left = left[~kept]
        words = np.packbits(np.concatenate([np.zeros(0, bool), *bits]), bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        order = np.concatenate([np.zeros(0, np.int64), *owners, left]).astype(np.int64)
        return cls(sizes, words, np.cumsum(ones) - ones, keys.take(pa.array(order)), len(keys) - len(left))

    def slots(self, terms: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for terms that are not keys. ``h`` are the terms' hashes."""
        out, todo, base = np.full(len(terms), -1, np.int64), np.arange(len(terms)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(h[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[at[hit] >> 6] + below
            todo, base = todo[~hit], base + size
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.alone < len(self.keys):
            rest = pc.index_in(terms, value_set=self.keys.slice(self.alone)).to_numpy(zero_copy_only=False)
            out = np.where(np.isnan(rest.astype(float)), out, self.alone + np.nan_to_num(rest.astype(float))).astype(np.int64)
        return out

    def row(self) -> dict:
        """Plain columns, to be stored in a table."""
        keys = self.keys.cast(pa.large_binary())
        return {"sizes": self.sizes, "words": self.words.tobytes(), "lengths": pc.binary_length(keys).to_pylist(),
                "key_bytes": b"".join(keys.to_pylist()), "alone": self.alone}

    @classmethod
    def of_row(cls, row: dict) -> PerfectHash:
        words = np.frombuffer(row["words"], "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)]).astype(np.int64)
        keys = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(bytes(row["key_bytes"]))])
        return cls(list(row["sizes"]), words, np.cumsum(ones) - ones, keys, row["alone"])
