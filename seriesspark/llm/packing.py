"""Packing documents into training sequences by order-preserving dynamic programming.

The documents, in ascending id order, are one stream of tokens, each closed by an
end id. A window is a run of at most ``length`` tokens of the stream; its cuts lie at
document ends or sentence ends, and every ``HARD_STEP`` tokens inside stretches of
more than ``length / 4`` tokens without either. A window costs its padding (none at a
power of two), ``WINDOW_COST``, and a truncation penalty for its end: none at a
document's end, ``SENTENCE`` at a sentence's, ``HARD`` elsewhere. With ``d`` the least
cost up to a cut and ``p`` its place,

    d[j] = min over i, p[j] - p[i] <= length, of d[i] + p[i]  +  length - p[j] + penalty[j] + WINDOW_COST,

whose minimum slides over a monotone queue; windows of a power of two are further
transitions from the cut at just that distance. As soon as the best ways to all cuts a
later window can start from have a cut in common, the windows before it are final and
are sent, so a task holds about a million tokens (measured; ways that never meet would
be held whole), whatever its share of the corpus.

Documents are range-partitioned by id, one stream per partition; a partition's last
window is padded. Partitions hold ``TASK_BYTES`` of text at least.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes first;
repeated rows are documents of their own; a text longer than a window is cut as above;
an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import materialize, partitions

END_ID = 1
SENTENCE, HARD, WINDOW_COST = 8, 64, 256   # in tokens of padding
HARD_STEP = 64
TASK_BYTES = 4 << 20
SLICE_BYTES = 2 << 20
CACHE_WORDS, CACHE_BYTES = 600_000, 32 << 20   # parts of words that a worker remembers, and their bytes


# Byte classes of the parts that the pre-tokenizer always cuts apart.
LETTER, DIGIT, SYMBOL, WHOLE = 1, 2, 3, 4
CLASS = np.full(256, SYMBOL, np.uint8)
CLASS[K.BLANK] = 0
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0x80:] = WHOLE
CLASS[ord("'")] = WHOLE          # contractions
STOP, CLOSE = np.zeros(256, bool), np.zeros(256, bool)
STOP[list(b".!?")] = True
CLOSE[list(b"\"')]")] = True


class Parts:
    """The parts of a slice of texts: ``first`` and ``last`` byte limits, and their range per document.

    Runs of letters (ASCII and Latin-1), single digits and runs of symbols are parts; a
    word with an apostrophe, a ``<|`` or any other character is one ``whole`` part, as it is.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        odd = kind == WHOLE
        mark = np.flatnonzero(data[:-1] == ord("<"))
        odd[mark[data[mark + 1] == ord("|")]] = True
        odd = np.flatnonzero(odd)
        begins = offsets[:-1][offsets[:-1] < len(data)]
        if len(odd):
            # a word reaches from behind the blank (or document's start) before to the next blank or start
            blank = np.flatnonzero(kind == 0)
            edge = np.union1d(np.concatenate([[0], blank + 1, begins]), [len(data)])
            at = np.unique(edge[np.searchsorted(edge, odd, "right") - 1])
            stop = np.union1d(np.concatenate([blank, begins]), [len(data)])
            kind[K.ranges(at, stop[np.searchsorted(stop, at, "right")] - at)] = WHOLE
        cut = np.empty(len(data) + 1, bool)
        cut[:1] = cut[-1:] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[:-1] |= kind == DIGIT
        cut[begins] = True
        edge = np.flatnonzero(cut)
        solid = kind[edge[:-1]] != 0
        self.first, self.last = edge[:-1][solid], edge[1:][solid]
        self.whole = kind[self.first] == WHOLE
        self.of_doc = np.searchsorted(self.first, offsets)
        lower = K.LOWER[data]
        if len(odd):
            lower = np.where(kind == WHOLE, data, lower)
        self.data, self.text = data, lower

    def sentence_ends(self) -> np.ndarray:
        """Numbers of the parts that end a sentence: a full stop, question or exclamation mark at a word's end, also before a closing quote or bracket, or the last part of a line."""
        if not len(self.first):
            return self.first
        tail = self.data[self.last - 1]
        closes = CLOSE[tail] & STOP[self.data[np.maximum(self.last - 2, self.first)]]
        found = np.flatnonzero(STOP[tail] | closes)
        after = self.last[found]
        inside = after < len(self.data)
        found = found[~inside | K.BLANK[self.data[np.minimum(after, len(self.data) - 1)]]]
        lines = np.searchsorted(self.first, np.flatnonzero(self.data == 10)) - 1
        found = np.sort(np.concatenate([found, lines[lines >= 0]]), kind="stable")
        return found[np.diff(found, prepend=-1) > 0]


class WordEncoder:
    """Token ids of whole texts, part by part, with the parts seen before looked up.

    For tokenizers that lower-case, drop white space and cut letters, digits and symbols
    apart: a text's ids are those of its parts, one after the other. Plain parts are
    tokenized many at a time, as the words of one text; a token that closes a word tells
    where the next part's ids begin. Parts are found again by hash and compared byte by byte.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)     # sorted, and the row of each
        self.words, self.pool = pa.array([], pa.large_binary()), np.zeros(0, np.int32)
        self.offsets, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokenize(self, words: list[bytes], plain: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words and their numbers, in pieces."""
        ids, counts = [], []
        for a in range(0, len(words), 4096):
            some = words[a:a + 4096]
            if plain:
                got = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
                ends = np.flatnonzero(self.closes[got]) + 1
                if len(ends) == len(some):
                    ids.append(got)
                    counts.append(np.diff(ends, prepend=0))
                    continue
            made = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, made), np.int64, len(made)))
            ids.append(np.fromiter(chain.from_iterable(made), np.int32, int(counts[-1].sum())))
        return ids, counts

    def encode(self, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and the number of ids before each part and after the last."""
        if not len(parts.first):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        code, words = K.coded(K.word_column(parts.text, parts.first, parts.last, K.NOT_BLANK))
        h = K.column_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, np.int64)
        row = np.full(len(words), -1, np.int64)
        row[known] = self.row[at[known]] if len(known) else row[known]
        if len(known):
            same = pc.equal(self.words.take(pa.array(row[known])), words.take(pa.array(known))).to_numpy(zero_copy_only=False)
            row[known[~same]] = -1
        whole = np.zeros(len(words), bool)
        whole[code[parts.whole]] = True
        new = row < 0
        order = np.concatenate([np.flatnonzero(new & ~whole), np.flatnonzero(new & whole)])
        if len(order):
            fresh, n_plain = words.take(pa.array(order)), int((new & ~whole).sum())
            listed = fresh.to_pylist()
            pieces = [self.tokenize(listed[:n_plain], True), self.tokenize(listed[n_plain:], False)]
            lengths = np.concatenate([x for p in pieces for x in p[1]])
            row[order] = len(self.words) + np.arange(len(order))
            self.offsets = np.concatenate([self.offsets, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, *[x for p in pieces for x in p[0]]])
            self.words = pa.concat_arrays([self.words, fresh])
            up = np.argsort(h[order], kind="stable")
            place = np.searchsorted(self.hashes, h[order][up])
            self.hashes, self.row = np.insert(self.hashes, place, h[order][up]), np.insert(self.row, place, row[order][up])
        per_part = self.lengths[row][code]
        ids = self.pool[K.ranges(self.offsets[row][code], per_part)]
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(per_part, out=upto[1:])
        if len(self.words) > CACHE_WORDS or self.words.nbytes > CACHE_BYTES:
            self.clear()
        return ids, upto


class Packer:
    """The dynamic programme over a stream of cuts, in ascending order of their places."""

    def __init__(self, length: int):
        self.length, self.powers = length, [1 << k for k in range(length.bit_length()) if 1 << k < length]
        self.place, self.cost, self.parent, self.first = [0], [0], [-1], 0   # of the cuts from number ``first`` on
        self.queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])         # (cost + place, place, number), ascending

    def powers_before(self, places: np.ndarray) -> tuple[list[int], list[int]]:
        """Numbers of the cuts at a power of two before each new place: ``found[at[j]:at[j + 1]]``."""
        low = max(0, len(self.place) - self.length - 1)
        every = np.concatenate([np.asarray(self.place[low:], np.int64), places])
        at, found = [], []
        for size in self.powers:
            i = np.searchsorted(every, places - size)
            j = np.flatnonzero(every[np.minimum(i, len(every) - 1)] == places - size)
            at.append(j)
            found.append(i[j] + self.first + low)
        at, found = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *found])
        order = np.argsort(at, kind="stable")
        return np.searchsorted(at[order], np.arange(len(places) + 1)).tolist(), found[order].tolist()

    def add(self, places: np.ndarray, penalties: np.ndarray) -> None:
        places, penalties = np.asarray(places, np.int64), np.asarray(penalties, np.int64)
        at, found = self.powers_before(places)
        length, queue, first, costs, parents = self.length, self.queue, self.first, self.cost, self.parent
        number, fixed = first + len(self.place), length + WINDOW_COST
        for j, (p, penalty) in enumerate(zip(places.tolist(), penalties.tolist())):
            least = p - length
            while queue[0][1] < least:
                queue.popleft()
            low, _, parent = queue[0]
            cost = low + fixed - p
            for i in found[at[j]:at[j + 1]]:
                if costs[i - first] + WINDOW_COST < cost:
                    cost, parent = costs[i - first] + WINDOW_COST, i
            cost += penalty
            costs.append(cost)
            parents.append(parent)
            key = cost + p
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, p, number))
            number += 1
        self.place.extend(places.tolist())

    def settled(self, last: bool = False) -> list[int]:
        """Places of the cuts that every best way shares, from the last settled one on; all of them if the stream ends here."""
        f = self.first
        end = self.place[-1]
        live = {f + len(self.place) - 1}
        if not last:
            i = len(self.place) - 1
            while i >= 0 and self.place[i] >= end - self.length:
                live.add(f + i)
                i -= 1
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            if self.parent[i - f] < f:   # the ways meet before what is held: at its first cut
                live = {f}
                break
            live.add(self.parent[i - f])
        meet = live.pop()
        way = [meet]
        while way[-1] > f:
            way.append(self.parent[way[-1] - f])
        cuts = [self.place[i - f] for i in reversed(way)]
        keep = meet - f
        self.place, self.cost, self.parent, self.first = self.place[keep:], self.cost[keep:], self.parent[keep:], meet
        self.parent[0] = -1
        return cuts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, so that its tasks share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts_of(sentences: np.ndarray, doc_ends: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties of the cuts of a slice that begins at ``start``: ``sentences`` are the places after its sentences."""
    nth = np.searchsorted(doc_ends, sentences)
    # not at a document's start, nor between its last word and the end id
    keep = (doc_ends[nth] > sentences + 1) & (sentences > np.append(start, doc_ends)[nth]) & (np.diff(sentences, prepend=start) > 0)
    inner = sentences[keep]
    place = np.concatenate([doc_ends, inner])
    penalty = np.concatenate([np.zeros(len(doc_ends), np.int64), np.full(len(inner), SENTENCE)])
    order = np.argsort(place, kind="stable")
    place, penalty = place[order], penalty[order]
    gap = np.diff(place, prepend=start)
    wide = np.flatnonzero(gap > length // 4)
    if len(wide):
        step = min(HARD_STEP, max(1, length // 4))
        n = (gap[wide] - 1) // step
        hard = np.repeat(place[wide] - gap[wide], n) + step * (K.ranges(np.ones(len(wide), np.int64), n))
        place, penalty = np.concatenate([place, hard]), np.concatenate([penalty, np.full(len(hard), HARD)])
        order = np.argsort(place)
        place, penalty = place[order], penalty[order]
    return place, penalty


PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
SEQUENCE = "task bigint, seq bigint, n_tokens bigint, padded bigint, ids array<int>, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, padded, ids, pieces``, a written table.

    ``padded`` is the length it is padded to; ``pieces`` say which tokens of which
    document lie where: ``doc_id, start, length, doc_tokens, offset``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, enc, packer, done = TaskContext.get().partitionId(), encoder(tokenizer_path), Packer(length), 0
        ids, origin, total = np.zeros(0, np.int32), 0, 0          # tokens from place ``origin`` on
        doc_ids, null, ends = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)   # documents that reach beyond it
        sizes = np.zeros(0, np.int64)

        def rows(cuts: list[int]) -> pa.RecordBatch:
            nonlocal ids, origin, doc_ids, null, ends, sizes, done
            cut = np.asarray(cuts, np.int64)
            size = np.diff(cut)
            n, upto = len(size), cut[-1]
            begin = np.sort(np.concatenate([cut[:-1], ends[(ends > cut[0]) & (ends < upto)]]), kind="stable")
            begin = begin[np.diff(begin, prepend=-1) > 0]
            stop = np.append(begin[1:], upto)
            doc, window = np.searchsorted(ends, begin, "right"), np.searchsorted(cut, begin, "right") - 1
            pieces = pa.StructArray.from_arrays(
                [pa.array(doc_ids[doc], mask=null[doc]), pa.array(begin - (ends - sizes)[doc]), pa.array(stop - begin), pa.array(sizes[doc]), pa.array(begin - cut[window])],
                fields=list(PIECE))
            power = np.bitwise_count(size) == 1
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task)), pa.array(np.arange(done, done + n)), pa.array(size), pa.array(np.where(power, size, length)),
                 pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(ids[:upto - origin])),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(window, np.arange(n + 1)), pa.int32()), pieces)],
                names=["task", "seq", "n_tokens", "padded", "ids", "pieces"])
            left = ends > upto
            ids, origin, done = ids[upto - origin:], int(upto), done + n
            doc_ids, null, ends, sizes = doc_ids[left], null[left], ends[left], sizes[left]
            return out

        for batch in batches:
            for a, b in K.slices(K.utf8(batch.column("text"))[1], SLICE_BYTES):
                part = batch.slice(a, b - a)
                parts = Parts(*K.utf8(part.column("text")))
                got, upto = enc.encode(parts)
                per_doc = np.diff(upto[parts.of_doc]) + 1
                doc_ends = total + np.cumsum(per_doc)
                sentence = parts.sentence_ends()
                place, penalty = cuts_of(total + upto[sentence + 1] + np.searchsorted(parts.of_doc, sentence, "right") - 1, doc_ends, total, length)
                ids = np.concatenate([ids, np.insert(got, upto[parts.of_doc[1:]], end_id)])
                column = part.column("doc_id")
                doc_ids = np.concatenate([doc_ids, column.fill_null(0).to_numpy(zero_copy_only=False)])
                null = np.concatenate([null, column.is_null().to_numpy(zero_copy_only=False)])
                ends, sizes, total = np.concatenate([ends, doc_ends]), np.concatenate([sizes, per_doc]), int(doc_ends[-1])
                packer.add(place, penalty)
                cuts = packer.settled()
                if len(cuts) > 1:
                    yield rows(cuts)
        cuts = packer.settled(last=True)
        if len(cuts) > 1:
            yield rows(cuts)

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(partitions(docs.sparkSession), -(-size // TASK_BYTES)))
    d = d.withColumn("_tie", F.xxhash64("text"))
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_tie") \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie")
    packed = materialize(d.mapInArrow(run, SEQUENCE), "sequences")
    # one row per task, so at most as many as the partitions above: broadcast, or the sequences would be shuffled
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = packed.groupBy("task").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return packed.join(F.broadcast(base.select("task", "base")), "task") \
        .select((F.col("seq") + F.col("base")).alias("sequence_id"), "n_tokens", "padded", "ids", "pieces")


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, its checksum taken from the sequence's ids: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, nested = batch.column("ids"), batch.column("pieces")
            ids, base = lists.flatten().to_numpy().astype("<i4"), np.asarray(lists.offsets)
            pieces = nested.flatten()
            window = np.repeat(np.arange(len(batch)), np.diff(np.asarray(nested.offsets)))
            field = {f.name: pieces.field(f.name) for f in PIECE}
            begin = (base[:-1] - base[0])[window] + field["offset"].to_numpy()
            crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(begin.tolist(), (begin + field["length"].to_numpy()).tolist())]
            yield pa.RecordBatch.from_arrays(
                [field["doc_id"], field["start"], field["length"], pa.array(crc, pa.int64()), field["doc_tokens"], batch.column("sequence_id").take(pa.array(window)), field["offset"]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(
        read, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
