"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of ``WIDTHS`` bits, low chunk first. Level 0 holds the
first chunk of every id, level k the (k+1)-th chunk of the ids that have one. A
continuation bitmap per level says which ids go on, and a rank directory (one
count per 512 bits) gives an id's place in the next level. So the id at any
position is read from a few bytes, without decoding a block; and the ids of a
document are one contiguous range on every level.

Documents are range-partitioned and sorted by id; each task tokenizes its run
and writes shard files to the shared folder, under a temporary name that is
renamed when the file is whole. The manifest lists the files of the task attempts
that Spark committed; files of lost attempts are never read.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes
first; repeated rows are written repeatedly; an empty table writes no files.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import materialize, partitions, scratch
from .store import Store

# Fixed values of the file format.
MAGIC = b"DACTOK01"
WIDTHS = (10, 6, 8, 8)   # bits of the chunks: even, 32 in all
RANK_BITS = 512
END_ID = 0
SHARD_TOKENS = 16 << 20  # a shard is closed when it has so many
SLICE_BYTES = 4 << 20    # text that is tokenized at once
CACHE_PIECES = 2 << 20   # pieces that a worker remembers
CACHE_WORDS = 300_000    # pre-tokens that a worker remembers


# --- coding ------------------------------------------------------------------

def pack(codes: np.ndarray, width: int) -> bytes:
    """Codes of ``width`` bits (even, 16 at most), one after the other."""
    out = []
    for a in range(0, len(codes), 1 << 20):
        part = codes[a:a + (1 << 20)].astype(np.uint64)
        part = np.concatenate([part, np.zeros(-len(part) % 4, np.uint64)]).reshape(-1, 4)
        four = part[:, 0] | (part[:, 1] << np.uint64(width)) | (part[:, 2] << np.uint64(2 * width)) | (part[:, 3] << np.uint64(3 * width))
        out.append(four.view(np.uint8).reshape(-1, 8)[:, :width // 2].tobytes())
    return b"".join(out)


def unpack(raw: bytes, width: int, bit: int, n: int) -> np.ndarray:
    """``n`` codes from bit ``bit`` of ``raw`` on; ``raw`` has 8 spare bytes."""
    at = bit + np.arange(n, dtype=np.int64) * width
    lanes = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    return ((lanes[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode(ids: np.ndarray) -> dict[str, bytes]:
    """Sections ``codes k``, ``more k`` and ``rank k`` of the levels."""
    out, rest = {}, ids.astype(np.uint32)
    for k, width in enumerate(WIDTHS):
        out[f"codes{k}"] = pack(rest & np.uint32((1 << width) - 1), width)
        high = rest >> np.uint32(width) if k + 1 < len(WIDTHS) else np.zeros(0, np.uint32)
        more = high != 0
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64)
        out[f"more{k}"] = bits.tobytes()
        out[f"rank{k}"] = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8").tobytes()
        rest = high[more]
    return out


class Shard:
    """Random access to a shard file through a ``read(offset, length)`` function."""

    def __init__(self, read):
        self.read = read
        head = read(0, 16)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.base = 16 + int.from_bytes(head[8:], "little")
        self.meta = json.loads(read(16, self.base - 16))
        self.sections = self.meta["sections"]
        n = self.meta["n_docs"]
        self.doc_ids = np.frombuffer(self.bytes("doc_ids", 0, 8 * n), "<i8")
        self.doc_null = np.frombuffer(self.bytes("doc_null", 0, n), np.uint8).astype(bool)
        self.doc_starts = np.frombuffer(self.bytes("doc_starts", 0, 8 * (n + 1)), "<i8")

    def bytes(self, section: str, first: int, length: int) -> bytes:
        at, size = self.sections[section]
        return self.read(self.base + at + first, max(0, min(length, size - first)))

    def rank(self, level: int, i: int) -> int:
        """Continuing ids before position ``i`` of a level."""
        block = i // RANK_BITS
        count = int.from_bytes(self.bytes(f"rank{level}", 8 * block, 8), "little")
        bits = np.unpackbits(np.frombuffer(self.bytes(f"more{level}", block * RANK_BITS // 8, RANK_BITS // 8), np.uint8), bitorder="little")
        return count + int(bits[:i % RANK_BITS].sum())

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids at positions ``first`` to ``first + n``."""
        out = np.zeros(n, np.uint32)
        at, shift = np.arange(n), 0  # places in ``out`` that the level's codes belong to
        for k, width in enumerate(WIDTHS):
            if not len(at):
                break
            lo = first * width // 8
            raw = self.bytes(f"codes{k}", lo, (len(at) * width + 7) // 8 + 1) + bytes(8)
            code = unpack(raw, width, first * width - 8 * lo, len(at))
            out[at] |= code << np.uint32(shift)
            shift += width
            if f"more{k}" not in self.sections:
                break
            lo = first // 8
            bits = np.unpackbits(np.frombuffer(self.bytes(f"more{k}", lo, len(at) // 8 + 2), np.uint8), bitorder="little")
            more = bits[first - 8 * lo:first - 8 * lo + len(at)].astype(bool)
            first, at = self.rank(k, first), at[more]
        return out


def shard_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> Iterator[bytes]:
    """The parts of a shard file, in order."""
    sections = {"doc_ids": np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
                "doc_null": np.array([x is None for x in doc_ids], np.uint8).tobytes(),
                "doc_starts": np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes(), **encode(ids)}
    places, at = {}, 0
    for name, raw in sections.items():
        places[name] = [at, len(raw)]
        at += len(raw)
    meta = json.dumps({"n_docs": len(doc_ids), "n_tokens": len(ids), "widths": WIDTHS, "sections": places}).encode()
    yield MAGIC + len(meta).to_bytes(8, "little") + meta
    yield from sections.values()


# --- tokenizing --------------------------------------------------------------

# Texts of these characters only are split here as the byte-level pre-tokenizer splits them.
PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PRE_TOKEN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


LETTER = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")  # one pre-token

# Byte classes that ``Encoder.starts`` cuts by.
SOLID = np.zeros(256, bool)   # printable ASCII but the blank
SOLID[0x21:0x7F] = True
ALPHA = np.zeros(256, bool)   # ASCII letters
ALPHA[0x41:0x5B] = ALPHA[0x61:0x7B] = True


class Encoder:
    """Tokenizes whole texts; a piece of text that came before is looked up.

    A text is cut only where the pre-tokenizer always cuts (see ``starts``), so the ids
    of the pieces are the ids of the text. Most pieces are one pre-token. They are found
    by a 64-bit hash and their length; the tables are emptied when they reach their limits.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library takes for added tokens; none holds a blank, so a piece cut at blanks has them whole
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)"
        self.added, self.added_bytes = re.compile(added), re.compile(added.encode())
        self.symbols, self.tokenize = byte_symbols(), self.tokenizer.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.keys, self.offsets, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.words = np.zeros(0, np.uint32), {}

    def word(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tokenize(raw.decode("latin-1").translate(self.symbols))]

    def piece(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if self.added.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if LETTER.fullmatch(text):
            return self.word(raw)
        if not PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for word in PRE_TOKEN.findall(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.word(word.encode())
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = ids
            out += ids
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ascending starts of the pieces of all documents.

        Cuts stand before a blank after a byte known not to be white space. Where no added
        token occurs, which they could divide, also before other ASCII after an ASCII letter,
        before a line feed after printable ASCII, and after such a line feed if it stands alone.
        """
        cut = np.zeros(len(data) + 1, bool)
        here, last = data[1:], data[:-1]
        solid = SOLID[last]
        latin = data[:-2] == 0xC3  # two bytes before the place: a Latin-1 letter or sign ends there
        blank = here == 0x20
        cut[1:-1] = blank & solid
        cut[2:-1] |= blank[1:] & latin & (last[1:] >= 0x80)
        if not self.added_bytes.search(data):
            cut[1:-1] |= ALPHA[last] & (here < 0x80) & ~ALPHA[here]
            feed = (here == 0x0A) & solid
            cut[1:-1] |= feed
            cut[2:-1] |= feed[:-1] & (SOLID[here[1:]] | (here[1:] == 0xC3))
        cut[offsets[:-1]] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and the number of ids of each."""
        starts = self.starts(data, offsets)
        ends = np.append(starts[1:], len(data))[:len(starts)]
        h = K.mix(K.word_hashes(data, starts, ends) + (ends - starts).astype(np.uint64))
        code, unique = _factorize(h)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        if not known.all():
            if len(self.keys) + len(unique) > CACHE_PIECES:
                self.clear()
                known[:] = False
            new = np.flatnonzero(~known)
            sample = np.zeros(len(unique), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            made, lengths = [], np.zeros(len(new), np.int64)
            at = sample[new]
            for j, (s, e) in enumerate(zip(starts[at].tolist(), ends[at].tolist())):
                ids = self.piece(data[s:e].tobytes())
                made += ids
                lengths[j] = len(ids)
            offs = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            self.pool = np.concatenate([self.pool, np.array(made, np.uint32)])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.offsets, self.lengths = keys[order], np.concatenate([self.offsets, offs])[order], np.concatenate([self.lengths, lengths])[order]
            place = np.searchsorted(self.keys, unique)
        lengths = self.lengths[place][code]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[K.ranges(self.offsets[place][code], lengths)]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


def _factorize(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd
    code, unique = pd.factorize(h)
    return code, np.asarray(unique, np.uint64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- Spark jobs --------------------------------------------------------------

def write_tokens(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the shards and return the manifest ``path, task, part, n_docs, n_tokens, start``.

    ``start`` counts the ids of all earlier shards. The manifest is a written
    table with one row per file.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    Store(folder).make_folder()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext
        store, enc = Store(folder), encoder(tokenizer_path)
        task, part = TaskContext.get().partitionId(), 0
        doc_ids, counts, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal part, doc_ids, counts, ids
            path = store.write(f"shard-{task:06d}-{part:04d}-{uuid.uuid4().hex[:8]}.dac", shard_file(doc_ids, counts, np.concatenate(ids)))
            row = pa.RecordBatch.from_pylist([{"path": path, "task": task, "part": part, "n_docs": len(doc_ids), "n_tokens": sum(counts)}],
                                             schema=pa.schema([("path", pa.string()), ("task", pa.int64()), ("part", pa.int64()),
                                                               ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            part, doc_ids, counts, ids = part + 1, [], [], []
            return row

        for batch in batches:
            offsets = K.utf8(batch.column("text"))[1]
            for a, b in K.slices(offsets, SLICE_BYTES):
                data, offs = K.utf8(batch.column("text").slice(a, b - a))
                got, n = enc.encode(data, offs)
                ends = np.cumsum(n)
                doc_ids += batch.column("doc_id").slice(a, b - a).to_pylist()
                counts += (n + 1).tolist()
                ids.append(np.insert(got, ends, END_ID))
                if sum(map(len, ids)) >= SHARD_TOKENS:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "_tie") \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie")
    manifest = materialize(rows.mapInArrow(write, "path string, task bigint, part bigint, n_docs bigint, n_tokens bigint"), "manifest")
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, *, digest: bool = True) -> DataFrame:
    """Per document, read back from the files: ``doc_id, start, n_tokens`` and ``ids`` or ``ids_crc32``."""
    field = "ids_crc32 bigint" if digest else "ids array<bigint>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                with Store.reader(f["path"]) as source:
                    shard = Shard(source.read_at)
                    a, n = 0, len(shard.doc_ids)
                    while a < n:  # about a million ids at a time
                        b = int(np.searchsorted(shard.doc_starts, shard.doc_starts[a] + (1 << 20), "right")) - 1
                        b = min(max(b, a + 1), n)
                        starts = shard.doc_starts[a:b + 1]
                        ids = shard.ids(int(starts[0]), int(starts[-1] - starts[0])).astype("<u4")
                        cuts = (starts - starts[0]).tolist()
                        per = [ids[s:e] for s, e in zip(cuts, cuts[1:])]
                        last = pa.array([zlib.crc32(x.tobytes()) for x in per], pa.int64()) if digest else \
                            pa.array([x.tolist() for x in per], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[a:b], mask=shard.doc_null[a:b]), pa.array(starts[:-1] + f["start"], pa.int64()),
                             pa.array(np.diff(starts), pa.int64()), last], names=["doc_id", "start", "n_tokens", field.split()[0]])
                        a = b

    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {field}")


def tokens_of(spark: SparkSession, path: str, first: int, n: int = 1) -> list[int]:
    """Random access to ids of one shard file, by reading only the bytes it needs."""
    with Store.reader(path) as source:
        return Shard(source.read_at).ids(first, n).tolist()
