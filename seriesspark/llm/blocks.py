"""Blocks of documents that exchange packed hashes.

Documents are dealt into blocks of bounded text by a hash of their id and text.
Per-document work runs once per block; what must be compared across documents
travels as packed arrays of hashes, one row per (block, hash range), already
reduced to one entry per hash and block. So a passage that a third of all
documents share costs one entry per block, and no task sees more than a block's
text or a hash range's entries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

# Text per block and words of text per hash range, at most on average. A level sends
# blocks x ranges rows: beyond some TB raise both, as far as memory allows.
BLOCK_BYTES = 12 << 20
RANGE_WORDS = 24 << 20


def blocked(docs: DataFrame, *, key: str, text: str) -> tuple[DataFrame, int]:
    """``block, doc_id, text`` and the number of hash ranges to use."""
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, partitions(docs.sparkSession) // 2, math.ceil(size / BLOCK_BYTES))
    ranges = max(partitions(docs.sparkSession), math.ceil(size / 6 / RANGE_WORDS))
    return d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), ranges


def by_range(block: int, n_ranges: int, h: np.ndarray, *others: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Split sorted hashes (and arrays beside them) into ranges: range numbers and packed parts."""
    width = np.uint64((1 << 64) // n_ranges + 1) if n_ranges > 1 else None
    cuts = np.searchsorted(h, np.arange(1, n_ranges, dtype=np.uint64) * width) if width is not None else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], cuts, [len(h)]])
    used = [r for r in range(n_ranges) if cuts[r] < cuts[r + 1]]
    return used, [[x[cuts[r]:cuts[r + 1]].tobytes() for x in (h, *others)] for r in used]


def u64(raw: bytes | pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw if isinstance(raw, bytes) else raw.as_py(), "<u8")


def runs_of(sorted_values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal entries."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
