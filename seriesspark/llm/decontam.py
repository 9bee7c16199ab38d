"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments, one row per run of training documents: the
documents with their word counts, the sorted distinct terms, and for each term
the ascending positions at which it stands in the segment. A benchmark chunk of
bounded size is sent to all segments; each of its phrases starts from its rarest
term there, takes that term's postings less the term's offset, and intersects
them with the offset-adjusted postings of the next rarer term until none or all
terms are used. What is left are exact starts of the phrase. With ``slop`` a term
may stand up to that many words away from its place (proximity matches).

The index holds the postings of all terms, so one index serves any benchmark. Items are
cut into pieces that overlap by a window less one word, and pieces fill chunks.

Defined cases: a null or wordless text has no words and no matches; a null item
has no phrase; an item shorter than the window is one phrase; an item with a null
id hits words but is not listed; repeated documents are indexed as rows of their
own; empty tables give no rows or no matches. A benchmark larger than one chunk
is matched chunk by chunk against the same stored index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import materialize, running_totals

SEGMENT_BYTES = 8 << 20     # text per index segment
CHUNK_WORDS = 4 << 20       # benchmark words that are broadcast at once (32 MB of hashes)
PIECE_WORDS = 1 << 16       # words of an item's piece
HASH_BYTES = 1 << 20        # text whose words are found at once
SEGMENTS = "segment string, doc_ids array<bigint>, n_words array<bigint>, firsts binary, terms binary, offsets binary, postings binary"
MATCHES = "segment string, row int, item_id bigint, spans array<struct<start:bigint,end:bigint>>"


def _words(column: pa.Array, a: int, b: int):
    """Word hashes of documents ``a`` to ``b`` and the word range of each, from runs of few bytes."""
    hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for s, e in K.slices(K.utf8(column.slice(a, b - a))[1], HASH_BYTES):
        data, offsets = K.utf8(column.slice(a + s, e - s))
        data = K.LOWER[data]
        starts, ends, own = K.words(data, offsets, K.ALNUM)
        hashes.append(K.word_hashes(data, starts, ends))
        first.append(own[1:] + first[-1][-1])
    return np.concatenate(hashes), np.concatenate(first)


def postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, where each one's positions begin and end, and the positions, ascending for a term."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return h[at], np.append(at, len(h)), order


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index segments of ``docs``; write them before matching, so their names are fixed."""
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        for batch in batches:
            data_offsets = K.utf8(batch.column("text"))[1]
            for a, b in K.slices(data_offsets, segment_bytes):
                h, first = _words(batch.column("text"), a, b)
                terms, limits, order = postings(h)
                row = [uuid.uuid4().hex, batch.column("doc_id").slice(a, b - a).to_pylist(), np.diff(first).tolist(),
                       first.astype("<i8").tobytes(), terms.astype("<u8").tobytes(),
                       limits.astype("<i8").tobytes(),
                       order.astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(row, [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4],
                                                      strict=True)],
                    names=["segment", "doc_ids", "n_words", "firsts", "terms", "offsets", "postings"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(segments, SEGMENTS)


def item_terms(items: DataFrame, window: int, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n_terms, terms`` (packed term hashes) of the pieces of items that have words; every window lies in one piece."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = _words(batch.column("text"), 0, batch.num_rows)
            owner, packed = [], []
            for i in range(batch.num_rows):
                item = h[first[i]:first[i + 1]].astype("<u8")
                for s in range(0, max(1, len(item) - window + 1) if len(item) else 0, PIECE_WORDS):
                    owner.append(i)
                    packed.append(item[s:s + PIECE_WORDS + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner, pa.int64())), pa.array([len(x) // 8 for x in packed], pa.int64()),
                                              pa.array(packed, pa.binary())], names=["item_id", "n_terms", "terms"])
    rows = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tokens, "item_id bigint, n_terms bigint, terms binary")


class Phrases:
    """The windows of a chunk's pieces: terms in one array, first term and length of each window, and its piece."""

    def __init__(self, pieces: list[tuple[int | None, bytes]], window: int):
        arrays = [np.frombuffer(t, "<u8") for _, t in pieces]
        self.ids = [i for i, _ in pieces]
        self.terms = np.concatenate([np.zeros(0, np.uint64), *arrays])
        n = np.array([len(a) for a in arrays], np.int64)
        counts = np.maximum(1, n - window + 1)
        self.start = K.ranges(np.cumsum(n) - n, counts)
        self.piece = np.repeat(np.arange(len(n)), counts)
        self.length = np.minimum(n, window)[self.piece]

    def present(self, term_ids: np.ndarray) -> np.ndarray:
        """Windows whose terms all occur, from the terms' ids (-1: does not)."""
        missing = np.concatenate([[0], np.cumsum(term_ids < 0)])
        return np.flatnonzero(missing[self.start + self.length] == missing[self.start])


class Segment:
    """One index row opened for lookups."""

    def __init__(self, firsts: bytes | pa.Buffer, terms: bytes | pa.Buffer, offsets: bytes | pa.Buffer, postings: bytes | pa.Buffer):
        self.firsts = np.frombuffer(firsts, "<i8")
        self.terms, self.offsets = np.frombuffer(terms, "<u8"), np.frombuffer(offsets, "<i8")
        self.postings = np.frombuffer(postings, "<u4").astype(np.int64)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def starts(self, term_ids: np.ndarray, slop: int = 0) -> np.ndarray:
        """Positions where the phrase stands, wholly inside one document."""
        sizes = self.offsets[term_ids + 1] - self.offsets[term_ids]
        at = None
        for j in np.argsort(sizes, kind="stable"):
            t = term_ids[j]
            plist = self.postings[self.offsets[t]:self.offsets[t + 1]]
            if at is None:
                at = plist - j
                continue
            i = np.searchsorted(plist, at + j - slop)
            at = at[(i < len(plist)) & (plist[np.minimum(i, len(plist) - 1)] <= at + j + slop)]
            if not len(at):
                break
        at = at[(at >= 0) & (at + len(term_ids) <= self.firsts[-1])]
        doc = np.searchsorted(self.firsts, at, "right")
        return at[doc == np.searchsorted(self.firsts, at + len(term_ids) - 1, "right")]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def match_chunk(index: DataFrame, items: list[tuple[int | None, bytes]], *, window: int, slop: int = 0) -> DataFrame:
    """Matches of one benchmark chunk: word spans per (document row, item)."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Phrases(sent.value, window)
        for batch in batches:
            for i in range(batch.num_rows):  # views of the batch, one segment at a time
                name = batch.column("segment")[i].as_py()
                seg = Segment(*[batch.column(c)[i].as_buffer() for c in ("firsts", "terms", "offsets", "postings")])
                found: dict[tuple[int, int | None], list] = {}
                ids = seg.lookup(chunk.terms)
                for w in chunk.present(ids).tolist():
                    s, n = int(chunk.start[w]), int(chunk.length[w])
                    for p in seg.starts(ids[s:s + n], slop).tolist():
                        row = int(np.searchsorted(seg.firsts, p, "right")) - 1
                        p -= int(seg.firsts[row])
                        found.setdefault((row, chunk.ids[chunk.piece[w]]), []).append((p, p + n))
                keys = list(found)
                spans = [[{"start": s, "end": e} for s, e in merged(found[k])] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.int32()),
                     pa.array([k[1] for k in keys], pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["segment", "row", "item_id", "spans"])

    return index.select("segment", "firsts", "terms", "offsets", "postings").mapInArrow(search, MATCHES)


def covered(spans: Column) -> Column:
    """Words covered by a sorted array of spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end")))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = 10, slop: int = 0, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (ids as sorted strings) for every document row."""
    items = running_totals(item_terms(benchmark, window, key=item_key, text=item_text), [F.col("item_id"), F.xxhash64("terms")],
                           {"before": F.col("n_terms")}, name="items")
    items = materialize(items.withColumn("chunk", F.floor(F.col("before") / chunk_words)), "chunks")
    last = items.agg(F.max("chunk")).first()[0]
    n_chunks = 0 if last is None else int(last) + 1

    def read_chunk(c: int) -> list[tuple[int | None, bytes]]:  # at most chunk_words words and one piece
        return [(r["item_id"], bytes(r["terms"])) for r in items.where(F.col("chunk") == c).select("item_id", "terms").collect()]

    index = materialize(build_index(docs, key=key, text=text), "index")
    found = None
    for c in range(n_chunks):
        m = match_chunk(index, read_chunk(c), window=window, slop=slop)
        m = m if n_chunks == 1 else materialize(m, "matches")
        found = m if found is None else found.unionByName(m)
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "d")) \
        .select("segment", "row", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    if found is None:
        return rows.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    hits = found.groupBy("segment", "row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
                                               F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = rows.join(hits.withColumnsRenamed({"segment": "_s", "row": "_r"}),
                     (F.col("segment") == F.col("_s")) & (F.col("row") == F.col("_r")), "left")
    return rows.select("doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"))
