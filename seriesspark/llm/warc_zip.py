"""WARC records in ZIP archives: writer, and a reader that never extracts.

An archive holds, as stored (uncompressed) members, the WARC file with one gzip
member per record, a CDXJ index of its records, and a description. The reader
parses the end-of-directory records (plain and ZIP64) and the central directory,
finds where a stored member's bytes begin, reads the index member, and then
range-reads and inflates single records.

Of records with equal payloads the one with the smallest page id is a response
and the others are revisits that refer to it; payloads under ``min_bytes`` are
always responses. The smallest id per digest comes from a partial aggregate and is a
written table before pages meet it, so Spark can split the pages of one payload.

Defined cases: a null html is the empty payload; a null URL leaves the target
header out; a null page id sorts before all ids and is read back as null; rows
that repeat the smallest page id of a payload are each a response; an empty table
writes no archive. One archive is written per task, closed at ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import materialize, partitions, scratch
from .store import Reader, Store

# ZIP record signatures and WARC names.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER, ABOUT_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
NO_ID = -2 ** 63  # stands for a null page id in the search for the smallest
ARCHIVE_BYTES = 256 << 20  # compressed record bytes after which a new archive is begun
RUN_BYTES = 8 << 20        # neighbouring records that are read at once


# --- records -----------------------------------------------------------------

def page_name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id in (None, NO_ID) else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header only."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{page_name(page_id)}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", digest))
    if revisit:
        head += [("WARC-Refers-To", f"<{page_name(first)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


# --- ZIP ---------------------------------------------------------------------

class ZipWriter:
    """Stored members, written in order; sizes follow the data, ZIP64 throughout."""

    def __init__(self):
        self.at, self.entries = 0, []

    def member(self, name: str, parts: Iterator[bytes]) -> Iterator[bytes]:
        begin, raw_name, crc, size = self.at, name.encode(), 0, 0
        # general flag 3: CRC and sizes stand behind the data; extra field 1: 8-byte sizes
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw_name), 20) \
            + raw_name + struct.pack("<HHQQ", 1, 16, 0, 0)
        yield head
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
            yield part
        tail = b"PK\7\10" + struct.pack("<IQQ", crc, size, size)
        yield tail
        self.at += len(head) + size + len(tail)
        self.entries.append((raw_name, crc, size, begin))

    def directory(self) -> bytes:
        out = b""
        for name, crc, size, begin in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, begin)
            out += ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name),
                                       len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
        n = len(self.entries)
        end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(out), self.at)
        locator = LOCATOR64 + struct.pack("<IQI", 0, self.at + len(out), 1)
        return out + end64 + locator + END + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


class ZipArchive:
    """The directory of an archive, by range reads: ``members[name] = (method, first byte, size)``."""

    def __init__(self, source: Reader):
        self.source = source
        tail_at = max(0, source.size - 65557)
        tail = source.read_at(tail_at, source.size - tail_at)
        i = tail.rfind(END)
        while i >= 0 and i + 22 + int.from_bytes(tail[i + 20:i + 22], "little") != len(tail):
            i = tail.rfind(END, 0, i)  # the signature can stand inside a comment
        if i < 0:
            raise ValueError("not a ZIP archive")
        count, size, at = struct.unpack("<HII", tail[i + 10:i + 20])
        if count == 0xFFFF or 0xFFFFFFFF in (size, at):
            locator = source.read_at(tail_at + i - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("ZIP64 locator missing")
            end64 = source.read_at(int.from_bytes(locator[8:16], "little"), 56)
            if end64[:4] != END64:
                raise ValueError("ZIP64 end record missing")
            count, size, at = struct.unpack("<QQQ", end64[32:56])
        self.members = dict(self._entries(source.read_at(at, size), count))

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        p = 0
        for _ in range(count):
            if raw[p:p + 4] != ENTRY:
                raise ValueError("damaged central directory")
            method, = struct.unpack("<H", raw[p + 10:p + 12])
            packed, size = struct.unpack("<II", raw[p + 20:p + 28])
            n, m, k = struct.unpack("<HHH", raw[p + 28:p + 34])
            at, = struct.unpack("<I", raw[p + 42:p + 46])
            name, extra = raw[p + 46:p + 46 + n].decode(), raw[p + 46 + n:p + 46 + n + m]
            while len(extra) >= 4:
                tag, length = struct.unpack("<HH", extra[:4])
                if tag == 1:  # only the fields that overflowed, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[4:4 + length // 8 * 8]))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    at = next(wide) if at == 0xFFFFFFFF else at
                extra = extra[4 + length:]
            yield name, (method, at, packed)
            p += 46 + n + m + k

    def stored(self, name: str) -> tuple[int, int]:
        """First byte and size of a stored member's data."""
        method, at, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        head = self.source.read_at(at, 30)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        return at + 30 + sum(struct.unpack("<HH", head[26:30])), size

    def read(self, name: str) -> bytes:
        return self.source.read_at(*self.stored(name))


def archive_parts(records: Iterator[tuple[str, dict, bytes]]) -> Iterator[bytes]:
    """The bytes of an archive, record by record; its index is kept until the end."""
    z, index, at = ZipWriter(), [], 0

    def members() -> Iterator[bytes]:
        nonlocal at
        for key, fields, raw in records:
            index.append(f"{key} {DATE} {json.dumps({**fields, 'offset': at, 'length': len(raw), 'filename': WARC_MEMBER})}\n")
            at += len(raw)
            yield raw

    yield from z.member(WARC_MEMBER, members())
    yield from z.member(INDEX_MEMBER, iter(["".join(sorted(index)).encode()]))
    yield from z.member(ABOUT_MEMBER, iter([json.dumps({"profile": "data-package", "resources": [WARC_MEMBER, INDEX_MEMBER]}).encode()]))
    yield z.directory()


# --- Spark jobs --------------------------------------------------------------

def mark_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, first_id, is_revisit`` per row."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    low = F.min(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)))
    first = pages.select(key, F.sha1(body.cast("binary")).alias("_sha1")).groupBy("_sha1").agg(low.alias("first_id"))
    # a written table: both sides of the join then have an exchange of their own, and the pages of a frequent payload can be split over tasks
    first = materialize(first, "first-pages")
    rows = rows.join(first, rows["sha1"] == F.col("_sha1"), "left").drop("_sha1")
    own = F.coalesce("page_id", F.lit(NO_ID)) == F.col("first_id")
    return rows.withColumn("is_revisit", ~own & (F.octet_length("html") >= min_bytes))


def write_archives(pages: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """Write the archives; the manifest has ``path, n_records`` of each."""
    folder = folder or scratch(pages.sparkSession, "archives")
    Store(folder).make_folder()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        store = Store(folder)
        rows = (r for batch in batches for r in _rows(batch))
        row = next(rows, None)
        while row is not None:
            n = 0

            def records() -> Iterator[tuple[str, dict, bytes]]:
                nonlocal row, n
                size = 0
                while row is not None and size < ARCHIVE_BYTES:
                    raw = record(row["page_id"], row["url"], row["html"], row["sha1"], row["first_id"], row["is_revisit"])
                    size, n = size + len(raw), n + 1
                    kind = "warc/revisit" if row["is_revisit"] else "text/html"
                    fields = {"url": row["url"], "mime": kind, "digest": row["sha1"]}
                    row = next(rows, None)
                    yield f"{fields['url'] or '-'}".replace(" ", "%20").replace("\n", "%0A"), fields, raw

            path = store.write(f"pages-{uuid.uuid4().hex}.wacz", archive_parts(records()))
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}],
                                             schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return materialize(mark_revisits(pages, **options).mapInArrow(write, "path string, n_records bigint"), "archive-list")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    data, offsets = K.utf8(batch.column("html"))
    others = batch.select(["page_id", "url", "sha1", "first_id", "is_revisit"]).to_pylist()
    for i, r in enumerate(others):
        yield r | {"html": data[offsets[i]:offsets[i + 1]].tobytes()}


def runs(index: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring records, at most RUN_BYTES together or one record."""
    out: list[dict] = []
    for e in sorted(index, key=lambda e: e["offset"]):
        if out and (e["offset"] != out[-1]["offset"] + out[-1]["length"] or e["offset"] + e["length"] - out[0]["offset"] > RUN_BYTES):
            yield out
            out = []
        out.append(e)
    if out:
        yield out


def read_archives(manifest: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records read back: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and ``payload`` if asked."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" \
        + (", payload binary" if payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])])
        number = lambda urn: int(urn) if (urn := urn.strip("<>").rpartition(":")[2]) else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Store.reader(path) as source:
                    archive = ZipArchive(source)
                    base, _ = archive.stored(WARC_MEMBER)
                    index = [json.loads(x.split(" ", 2)[2]) for x in archive.read(INDEX_MEMBER).decode().split("\n") if x]
                    for run in runs(index):
                        raw = source.read_at(base + run[0]["offset"], run[-1]["offset"] + run[-1]["length"] - run[0]["offset"])
                        out = []
                        for e in run:
                            at = e["offset"] - run[0]["offset"]
                            fields, http, body = parse_record(raw[at:at + e["length"]])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                            refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                            out.append({"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
                                        "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
                                        "record_type": fields["WARC-Type"], "refers_to": refers, "payload": body})
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in types.names} for r in out], schema=types)

    spread = manifest.select("path").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, schema)
