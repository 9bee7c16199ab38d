"""Exact substring dedup by level-wise doubling.

A window of ``length`` words is removed from a document if the same words also
start in a document with a smaller id. Windows are found level by level, at
lengths L/4, L/2 and L (rounded up): only windows that are repeated at one level
are extended to about twice that length, and the rest never travel again.

Level 1 looks at anchors: the window's smallest short hash, which equal windows
have at the same place, so no repeat is lost and about one position in five is
sent. Level 2 extends the anchors found in two documents to the half-length
window on that side which lies inside the full window. Level 3 sends the full
windows whose half is repeated, with 96-bit hashes and the smallest id holding
them, and gets back the smallest id of all. Each level sends one entry per
distinct hash and block (see ``blocks``).

Defined cases: a null or wordless text has no words; a text shorter than the
window loses nothing; a null ``doc_id`` is the smallest id; rows that repeat an
id never remove each other's words; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .blocks import blocked, by_range, runs_of, u64

SLICE_BYTES = 2 << 20
NO_ID = -2 ** 63
LEFT = np.uint64(0x9E3779B97F4A7C15)  # tells left half-windows from right ones
SENT = "range int, block int, hashes binary, more binary, ids binary"


@dataclass
class Slice:
    """Words of a run of documents and the full windows among them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    h: np.ndarray
    ids: np.ndarray        # of each document
    window: np.ndarray     # first word of each full window
    anchor: np.ndarray     # its anchor's first word
    half: np.ndarray       # first word of its half-window
    left: np.ndarray       # whether that half ends with the anchor

    def doc(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def open_slices(docs: pa.Table, length: int) -> Iterator[Slice]:
    short, half = -(-length // 4), -(-length // 2)
    column = docs.column("text").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    ids = docs.column("doc_id").fill_null(NO_ID).to_numpy()
    data, offsets = K.utf8(column)
    for a, b in K.slices(offsets, SLICE_BYTES):
        d, o = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, first = K.words(d, o, K.NOT_BLANK)
        h = K.word_hashes(d, starts, ends)
        last = np.repeat(first[1:], np.diff(first))  # end of each word's document
        window = np.flatnonzero(np.arange(len(h)) + length <= last)
        g = K.window_hashes(h, short)
        # the high bits decide, the place breaks ties: equal windows agree on both
        bits = np.uint64(max(1, len(g)).bit_length())
        low = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
        span, n = 1, length - short + 1
        while 2 * span <= n:
            low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
            span *= 2
        if n > span:
            low = np.minimum(low[:len(low) - (n - span)], low[n - span:]) if len(low) > n - span else low[:0]
        anchor = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) if len(window) else window
        left = anchor - window > length - half
        yield Slice(d, starts, ends, first, h, ids[a:b], window, anchor, np.where(left, anchor + short - half, anchor), left)


def _sent(block: int, ranges: int, h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> pa.Table:
    used, parts = by_range(block, ranges, h, more, ids)
    return pa.table({"range": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()),
                     "hashes": pa.array([p[0] for p in parts], pa.binary()), "more": pa.array([p[1] for p in parts], pa.binary()),
                     "ids": pa.array([p[2] for p in parts], pa.binary())})


def _repeats(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and whether two documents of the block have them."""
    h = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in pairs]])
    ids = np.concatenate([np.zeros(0, np.int64), *[x for _, x in pairs]])
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    at = runs_of(h)
    if not len(at):
        return h, np.zeros(0, np.uint8)
    return h[at], (np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)).astype(np.uint8)


def _has(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _wanted(back: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[u64(x) for x in back.column("hashes")]]))


def repeated(sent: DataFrame) -> DataFrame:
    """Per range: to each block those of its hashes that two documents have."""
    def reduce(t: pa.Table) -> pa.Table:
        parts = [u64(x) for x in t.column("hashes")]
        h = np.concatenate(parts)
        twice = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("more")]).astype(bool)
        order = np.argsort(h, kind="stable")
        at = runs_of(h[order])
        size = np.diff(np.append(at, len(h)))
        alive = (size > 1) | np.logical_or.reduceat(twice[order], at)
        keep = np.empty(len(h), bool)
        keep[order] = np.repeat(alive, size)
        ends = np.cumsum([len(p) for p in parts])
        out = [p[keep[e - len(p):e]].tobytes() for p, e in zip(parts, ends)]
        return pa.table({"block": t.column("block"), "hashes": pa.array(out, pa.binary())})
    return sent.groupBy("range").applyInArrow(reduce, "block int, hashes binary")


def smallest(sent: DataFrame) -> DataFrame:
    """Per range: to each block the windows that a document outside it, with a smaller id, has."""
    def reduce(t: pa.Table) -> pa.Table:
        parts = [u64(x) for x in t.column("hashes")]
        h = np.concatenate(parts)
        more = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in t.column("more")])
        ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in t.column("ids")])
        order = np.lexsort((more, h))
        at = runs_of(h[order], more[order])
        low = np.empty(len(h), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(h))))
        ends = np.cumsum([len(p) for p in parts])
        cut = [slice(e - len(p), e) for p, e in zip(parts, ends)]
        less = [low[c] < ids[c] for c in cut]
        return pa.table({"block": t.column("block"),
                         "hashes": pa.array([h[c][m].tobytes() for c, m in zip(cut, less)], pa.binary()),
                         "more": pa.array([more[c][m].tobytes() for c, m in zip(cut, less)], pa.binary()),
                         "ids": pa.array([low[c][m].tobytes() for c, m in zip(cut, less)], pa.binary())})
    return sent.groupBy("range").applyInArrow(reduce, "block int, hashes binary, more binary, ids binary")


def _windows(s: Slice, alive: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """96-bit hashes of the full windows that are alive, and their first words."""
    at = s.window[alive]
    low = K.window_hashes(s.h, length, seed=1)
    return K.window_hashes(s.h, length)[at], (low[at] >> np.uint64(32)).astype(np.uint32), at


def _half_hashes(s: Slice, length: int) -> np.ndarray:
    half = K.window_hashes(s.h, -(-length // 2))
    return half[s.half] ^ np.where(s.left, LEFT, np.uint64(0)) if len(s.half) else np.zeros(0, np.uint64)


def dedup_substrings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept``: removed word spans and the words left, joined by spaces."""
    rows, ranges = blocked(docs, key=key, text=text)
    short = -(-length // 4)
    texts = rows.groupBy("block")

    def block_of(t: pa.Table) -> int:
        return t.column("block")[0].as_py()

    def full_windows(s: Slice, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes, first words and document ids of the windows whose half is repeated."""
        h, more, at = _windows(s, _has(_half_hashes(s, length), wanted), length)
        return h, more, at, s.ids[s.doc(at)]

    def level1(t: pa.Table) -> pa.Table:
        found = []
        for s in open_slices(t, length):
            at = s.anchor[runs_of(s.anchor)]
            found.append((K.window_hashes(s.h, short)[at], s.ids[s.doc(at)]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        h, twice = _repeats(found)
        return _sent(block_of(t), ranges, h, twice, np.zeros(0, np.int64))

    def level2(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _sent(0, ranges, np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
        wanted, found = _wanted(back), []
        for s in open_slices(t, length):
            alive = _has(K.window_hashes(s.h, short)[s.anchor], wanted) if len(s.anchor) else np.zeros(0, bool)
            found.append((_half_hashes(s, length)[alive], s.ids[s.doc(s.window[alive])]))
        h, twice = _repeats(found)
        return _sent(block_of(t), ranges, h, twice, np.zeros(0, np.int64))

    def level3(t: pa.Table, back: pa.Table) -> pa.Table:
        wanted = _wanted(back)
        found = [full_windows(s, wanted) for s in open_slices(t, length)] if t.num_rows else []
        h, more, ids = (np.concatenate([np.zeros(0, x), *[f[i] for f in found]]) for i, x in ((0, np.uint64), (1, np.uint32), (3, np.int64)))
        order = np.lexsort((more, h))
        h, more, ids = h[order], more[order], ids[order]
        at = runs_of(h, more)
        low = np.minimum.reduceat(ids, at) if len(at) else ids
        return _sent(block_of(t) if t.num_rows else 0, ranges, h[at], more[at], low)

    def remove(t: pa.Table, halves: pa.Table) -> pa.Table:
        out = []
        own = halves.filter(pc.is_null(halves.column("ids")))
        low = halves.filter(pc.is_valid(halves.column("ids")))
        wanted = _wanted(own)
        slices = [full_windows(s, wanted) for s in open_slices(t, length)] if t.num_rows else []
        # smallest ids: of this block, and smaller ones from elsewhere
        h = np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in slices], *[u64(x) for x in low.column("hashes")]])
        more = np.concatenate([np.zeros(0, np.uint32), *[x[1] for x in slices], *[np.frombuffer(x.as_py(), "<u4") for x in low.column("more")]])
        ids = np.concatenate([np.zeros(0, np.int64), *[x[3] for x in slices], *[np.frombuffer(x.as_py(), "<i8") for x in low.column("ids")]])
        order = np.lexsort((more, h))
        at = runs_of(h[order], more[order])
        least = np.empty(len(h), np.int64)
        if len(at):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(h))))
        begin = 0
        fresh = open_slices(t, length) if t.num_rows else ()
        for s, (hh, _, word, doc_ids) in zip(fresh, slices):
            gone = least[begin:begin + len(hh)] < doc_ids
            begin += len(hh)
            out.append(_kept(s, word[gone], length))
        if not out:
            return RESULT.empty_table()
        ids_back = pa.concat_arrays(t.column("doc_id").chunks) if t.column("doc_id").num_chunks != 1 else t.column("doc_id").chunk(0)
        whole = pa.concat_tables(out)
        return whole.add_column(0, "doc_id", ids_back).cast(RESULT)

    sent1 = texts.applyInArrow(level1, SENT)
    back1 = repeated(sent1)
    sent2 = texts.cogroup(back1.groupBy("block")).applyInArrow(level2, SENT)
    back2 = repeated(sent2)
    sent3 = texts.cogroup(back2.groupBy("block")).applyInArrow(level3, SENT)
    none = F.lit(None).cast("binary")
    back3 = back2.select("block", "hashes", none.alias("more"), none.alias("ids")).unionByName(smallest(sent3))
    return texts.cogroup(back3.groupBy("block")).applyInArrow(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept string")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def _kept(s: Slice, gone: np.ndarray, length: int) -> pa.Table:
    """What is left of a slice's documents when the windows at ``gone`` go."""
    cover = np.zeros(len(s.h) + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + length, -1)
    drop = np.cumsum(cover)[:-1] > 0
    n = np.diff(s.first)
    # spans: runs of dropped words, cut at document limits
    edge = np.zeros(len(drop) + 1, bool)
    edge[s.first] = True
    begin = np.flatnonzero(drop & (edge[:-1] | ~np.append(False, drop[:-1]))) if len(drop) else np.zeros(0, np.int64)
    stop = np.flatnonzero(drop & (edge[1:] | ~np.append(drop[1:], False))) + 1 if len(drop) else begin
    doc = np.searchsorted(s.first, begin, "right") - 1
    per_doc = np.searchsorted(begin, s.first)
    spans = pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(begin - s.first[doc], pa.int64()), pa.array(stop - s.first[doc], pa.int64())], names=["start", "end"]))
    stay = np.flatnonzero(~drop)
    size = s.ends[stay] - s.starts[stay] + 1  # each word and a separator
    total = np.concatenate([[0], np.cumsum(size)])
    padded = np.append(s.data, np.uint8(0x20))
    raw = padded[K.ranges(s.starts[stay], size)]
    raw[total[1:] - 1] = 0x20
    bounds = total[np.searchsorted(stay, s.first)]
    texts = [raw[a:max(a, b - 1)].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    removed = np.concatenate([[0], np.cumsum(drop)])
    return pa.table({"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed[s.first[1:]] - removed[s.first[:-1]], pa.int64()),
                     "removed": spans, "kept": pa.array(texts, pa.string())})
