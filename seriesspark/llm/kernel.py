"""Vectorised word kernels over Arrow text columns, for the Arrow-batch operators.

Text stays in the Arrow buffer as UTF-8 bytes; word limits, word hashes and
window hashes are NumPy arrays over it. ``slices`` cuts a batch into runs of
documents of bounded bytes, so temporaries stay small whatever the batch size;
a document longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

C1, C2, C3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
LONG_WORD = 128  # bytes; longer words are hashed one by one

# Byte classes: UTF-8 continuation and lead bytes are never separators, so a class of
# ASCII separators works on bytes.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
NOT_BLANK = ~BLANK
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True  # after A-Z became a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls become empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of documents with at most ``limit`` bytes, or one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the word range ``first[d]:first[d + 1]`` of each document."""
    inside = member[data]
    left, right = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    left[1:], right[:-1] = inside[:len(data)], inside
    left[offsets] = False   # nothing reaches over a document's limits
    cut = inside.copy()
    after = np.append(inside, False)[1:]
    ends_at = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    after[ends_at] = False
    starts = np.flatnonzero(cut & ~left[:-1])
    ends = np.flatnonzero(cut & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * C1
    h = (h ^ (h >> np.uint64(33))) * C2
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time for all words at once."""
    length = ends - starts
    h = C3 ^ length.astype(np.uint64)
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    short = length <= LONG_WORD
    todo = np.flatnonzero(short) if not short.all() else None
    done = 0
    while todo is None or len(todo):
        s, l = (starts, length) if todo is None else (starts[todo], length[todo])
        rest = np.minimum(l - done, 8)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest) * 8).astype(np.uint64) if (rest > 0).all() else \
            np.where(rest > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.maximum(rest, 1)) * 8).astype(np.uint64), np.uint64(0))
        old = h if todo is None else h[todo]
        new = (old ^ (lanes[s + done] & keep)) * C1
        new = (new ^ (new >> np.uint64(32))) * C2
        new ^= new >> np.uint64(29)
        if todo is None:
            h = new
        else:
            h[todo] = new
        done += 8
        more = l > done
        todo = np.flatnonzero(more) if todo is None else todo[more]
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return h


def window_hashes(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` word hashes from each position on (the last ones are cut off)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(0x2545F4914F6CDD1D + 2 * seed), np.uint64)
    for j in range(length):
        acc = (acc + h[j:j + n]) * (C1 if seed == 0 else C2)
        acc ^= acc >> np.uint64(31)
    return mix(acc)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def word_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, member: np.ndarray) -> pa.Array:
    """The words as a binary column; ``starts`` and ``ends`` are all words of ``data`` by ``member``."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[member[data]])])


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column's entries and its distinct entries, compared byte by byte."""
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def column_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of a binary column's entries."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return word_hashes(data[:offsets[-1]], offsets[:-1], offsets[1:])
