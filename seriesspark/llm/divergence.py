"""How the sources of a language differ: an audit of smoothed term frequencies.

First pass: exact document frequencies; a language keeps its terms of at least
``min_docs`` documents. The kept terms are dealt into shards of bounded size, each a
minimal perfect hash with stored keys. Second pass: tasks get the shards by
broadcast, look up the distinct terms of a slice of texts (verified against the
stored keys) and add to dense counts, one array of a language's slots per (language,
source). Broadcast shards never exceed ``ROUND_BYTES``: a larger vocabulary takes
further passes, each over the shards of one round.

Sources are compared by blocks of sources and chunks of slots, so no task holds a
whole vocabulary or all sources. Frequencies are whole numbers found by long
division, exact up to 9e15 term occurrences in a language.

Defined cases: null text, lang and source are ''; every row is a document, also one
that repeats a ``doc_id``; a group without terms has the smoothed frequencies of an
empty group; a language without kept terms gives ``pair`` rows of value 0; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import materialize
from .perfect_hash import PerfectHash

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
SCALE, SMOOTH = 1_000_000_000, 5
SLICE_BYTES = 4 << 20
TABLE_ROWS = 200_000          # (language, term) rows a task holds before it sums or sends them
SHARD_TERMS = 1 << 18         # kept terms of a shard, on average
ROUND_BYTES = 256 << 20       # shards that are broadcast at once
DENSE_BYTES = 64 << 20        # dense counts a task holds before it sends them
CHUNK, BLOCK = 4096, 256      # slots and sources that are compared at once


def _input(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of a batch with the document and code of every term, and the distinct terms."""
    for a, b in K.slices(K.utf8(batch.column("text"))[1], SLICE_BYTES):
        part = batch.slice(a, b - a)
        data, offsets = K.utf8(part.column("text"))
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, LETTER)
        code, terms = K.coded(K.word_column(data, starts, ends, LETTER))
        yield part, np.repeat(np.arange(len(part)), np.diff(first)), code, terms


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang, term, df`` of all terms, from ``lang, text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("df", "sum")]).rename_columns(["lang", "term", "df"])

        for batch in batches:
            for part, doc, code, terms in _slices(batch):
                lang, langs = K.coded(part.column("lang"))
                once = np.unique(doc * max(len(terms), 1) + code)
                key, df = np.unique(lang[once // max(len(terms), 1)] * max(len(terms), 1) + once % max(len(terms), 1), return_counts=True)
                held.append(pa.table({"lang": langs.take(pa.array(key // max(len(terms), 1))), "df": pa.array(df),
                                      "term": terms.take(pa.array(key % max(len(terms), 1))).cast(pa.large_string())}).select(["lang", "term", "df"]))
            if sum(map(len, held)) >= TABLE_ROWS:
                held = [summed()]
                if len(held[0]) >= TABLE_ROWS // 2:
                    yield from _cast(held.pop()).to_batches(max_chunksize=65536)
        if held:
            yield from _cast(summed()).to_batches(max_chunksize=65536)

    def _cast(t: pa.Table) -> pa.Table:
        return t.cast(pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64())])).combine_chunks()

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, df bigint") \
        .groupBy("lang", "term").agg(F.sum("df").alias("df"))


def shards_of(kept: DataFrame) -> DataFrame:
    """``lang, shard, shards, n, bytes`` and the columns of a perfect hash, from ``lang, term``."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = K.column_hashes(batch.column("term").cast(pa.large_string()).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("term").combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
        row = PerfectHash.build(keys).row()
        first = table.slice(0, 1)
        own = {"lang": first.column("lang").to_pylist(), "shard": first.column("shard").to_pylist(), "shards": first.column("shards").to_pylist(),
               "n": [len(table)], "bytes": [len(row["words"]) + len(row["key_bytes"]) + 8 * len(table)]}
        t = pa.table({**own, **{k: [v] for k, v in row.items()}})
        ints = pa.list_(pa.int32())
        kinds = {"shard": pa.int32(), "shards": pa.int32(), "n": pa.int32(), "sizes": ints, "lengths": ints, "alone": pa.int32()}
        return t.cast(pa.schema([(f.name, kinds.get(f.name, f.type)) for f in t.schema]))

    schema = "lang string, shard int, shards int, n int, bytes bigint, sizes array<int>, words binary, lengths array<int>, key_bytes binary, alone int"
    per_lang = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_TERMS).cast("int").alias("shards"))
    dealt = kept.select("lang", "term").mapInArrow(hashed, "lang string, term string, h bigint").join(per_lang, "lang") \
        .withColumn("shard", F.pmod("h", "shards").cast("int")).select("lang", "shard", "shards", "term")
    return dealt.groupBy("lang", "shard").applyInArrow(build, schema)


def rounds(shards: DataFrame) -> list[tuple[tuple, tuple]]:
    """First and last ``(lang, shard)`` of each round; one row per shard passes the driver."""
    out: list[tuple[tuple, tuple]] = []
    room = 0
    for r in shards.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():
        at = (r["lang"], r["shard"])
        if out and r["bytes"] <= room:
            out[-1] = (out[-1][0], at)
            room -= r["bytes"]
        else:
            out.append((at, at))
            room = ROUND_BYTES - r["bytes"]
    return out


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang, source, shard, idx, n``: dense counts of one round's slots; every group has a row at least (null ``shard``)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])  # at most ROUND_BYTES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, list] = {}     # language: (first slot, shard, hash) of the round's shards
        width: dict[str, int] = {}
        number: dict[str, int] = {}
        for row in sorted(sent.value, key=lambda r: (r["lang"], r["shard"])):
            at = width.get(row["lang"], 0)
            hashes.setdefault(row["lang"], []).append((at, row["shard"], PerfectHash.of_row(row)))
            width[row["lang"]], number[row["lang"]] = at + row["n"], row["shards"]
        slots: dict[tuple[str, str], np.ndarray] = {}
        room = DENSE_BYTES

        def send() -> Iterator[pa.RecordBatch]:
            rows = []
            for (lang, source), dense in slots.items():
                rows.append((lang, source, None, [], []))
                for at, shard, ph in hashes.get(lang, ()):
                    part = dense[at:at + len(ph.keys)]
                    idx = np.flatnonzero(part)
                    rows.append((lang, source, shard, idx.tolist(), part[idx].tolist()))
            slots.clear()
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "source", "shard", "idx", "n"])

        def look_up(lang: str, terms: pa.Array) -> np.ndarray:
            h = K.column_hashes(terms)
            of = h.view(np.int64) % number[lang]
            out = np.full(len(terms), -1, np.int64)
            for at, shard, ph in hashes[lang]:
                own = np.flatnonzero(of == shard)
                got = ph.slots(terms.take(pa.array(own)), h[own])
                out[own] = np.where(got >= 0, got + at, -1)
            return out

        for batch in batches:
            for part, doc, code, terms in _slices(batch):
                lang, langs = K.coded(part.column("lang"))
                source, sources = K.coded(part.column("source"))
                group = lang * len(sources) + source
                order = np.argsort(group[doc], kind="stable")
                cuts = np.searchsorted(group[doc][order], np.arange(len(langs) * len(sources) + 1))
                places = {name: look_up(name, terms) for name in langs.to_pylist() if name in hashes}
                for g in np.unique(group).tolist():
                    name, of = langs[g // len(sources)].as_py(), sources[g % len(sources)].as_py()
                    dense = slots.get((name, of))
                    if dense is None:
                        if room < 0:
                            yield from send()
                            room = DENSE_BYTES
                        dense = slots[name, of] = np.zeros(width.get(name, 0), np.int64)
                        room -= dense.nbytes + 64
                    if name in places:
                        at = places[name][code[order[cuts[g]:cuts[g + 1]]]]
                        at, times = np.unique(at[at >= 0], return_counts=True)
                        dense[at] += times
        yield from send()

    out = docs.mapInArrow(add, "lang string, source string, shard int, idx array<int>, n array<bigint>")
    return out.select("lang", "source", "shard", F.explode_outer(F.arrays_zip("idx", "n")).alias("e")) \
        .select("lang", "source", "shard", F.col("e.idx").alias("idx"), F.col("e.n").alias("n"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), digit by digit in base 1000, so that no product leaves 64 bits."""
    whole, rest, out = total + SMOOTH * kept, count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):  # SCALE is 1000 three times
        digit = F.call_function("div", rest * 1000, whole)
        out, rest = out * 1000 + digit, rest * 1000 - digit * whole
    return out + 1


def compared(shares: DataFrame, tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value``: the summed differences of every two sources ``a < b`` of a language.

    ``shares`` has ``lang, source, shard, idx, p`` of the terms that occur, ``tiles`` the chunks
    ``lang, shard, chunk, width`` of the kept terms, ``groups`` has ``lang, source, p0``, the share
    of a term that does not occur. A tile meets the sources of two blocks as a matrix.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    head = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    none = head.select("lang").distinct().select("lang", F.lit(-1).alias("shard"), F.lit(-1).alias("chunk"), F.lit(0).alias("width"))
    head = head.join(tiles.unionByName(none), "lang").select("lang", "shard", "chunk", "block", "blocks", "source", F.col("p0").alias("p"), F.lit(-1).alias("at"), "width")
    rows = shares.join(groups.join(blocks, "lang").select("lang", "source", "blocks"), ["lang", "source"]) \
        .select("lang", "shard", F.floor(F.col("idx") / CHUNK).cast("int").alias("chunk"), F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"), "blocks",
                "source", "p", (F.col("idx") % CHUNK).cast("int").alias("at"), F.lit(0).alias("width"))
    both = head.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def compare(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        names, row = np.unique(table.column("source").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        width, p, block = int(table.column("width").to_numpy().max()), table.column("p").to_numpy(), table.column("block").to_numpy()
        heads = at < 0
        share_of, block_of = np.zeros((len(names), width), np.int64), np.zeros(len(names), np.int64)
        share_of[row[heads]] = p[heads][:, None]
        share_of[row[~heads], at[~heads]] = p[~heads]
        block_of[row[heads]] = block[heads]
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        first, second, value = [], [], []
        for x in range(len(names)):
            others = np.arange(x + 1, len(names))
            others = others if one else others[block_of[others] != block_of[x]]
            first += [names[x]] * len(others)
            second += names[others].tolist()
            value.append(np.abs(share_of[others] - share_of[x]).sum(axis=1))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(first), pa.string()), "a": pa.array(first, pa.string()),
                         "b": pa.array(second, pa.string()), "value": pa.array(np.concatenate([np.zeros(0, np.int64), *value]))})

    parts = both.groupBy("lang", "shard", "chunk", "i", "j").applyInArrow(compare, "lang string, a string, b string, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text",
                      min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far a source is from the others (``pair``) and its most typical terms (``term``)."""
    docs = _input(docs, lang, source, text)
    kept = document_frequencies(docs).where(F.col("df") >= min_docs).select("lang", "term")
    shards = materialize(shards_of(materialize(kept, "kept-terms")), "shards")
    counts = None
    for first, last in rounds(shards) or [(("", 0), ("", -1))]:
        place = F.struct("lang", "shard")
        now = shards.where((place >= F.struct(F.lit(first[0]), F.lit(first[1]))) & (place <= F.struct(F.lit(last[0]), F.lit(last[1]))))
        one = recount(docs, now).groupBy("lang", "source", "shard", "idx").agg(F.sum("n").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    counts = materialize(counts, "counts")
    cells = counts.where(F.col("idx").isNotNull())

    # totals of groups and languages, 0 without terms
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = counts.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    groups = groups.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)), "groups")
    shares = cells.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]) \
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).select("lang", "source", "shard", "idx", "p")
    shares = materialize(shares, "shares")

    # the kept terms with their shares in the language
    of_lang = cells.groupBy("lang", "shard", "idx").agg(F.sum("n").alias("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    typical = terms_of(shards).join(of_lang, ["lang", "shard", "idx"]).join(whole, "lang") \
        .select("lang", "shard", "idx", "item", share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    terms = shares.join(typical, ["lang", "shard", "idx"]).where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)

    tiles = shards.select("lang", "shard", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("chunk")) \
        .select("lang", "shard", "chunk", F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).alias("width"))
    sums = compared(shares, tiles, groups.select("lang", "source", "p0"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value") \
        .select("lang", "e.source", "e.item", "value").withColumn("rank", F.row_number().over(rank))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(terms.withColumn("part", F.lit("term")).select(*cols))


def terms_of(shards: DataFrame) -> DataFrame:
    """``lang, shard, idx, item``: the stored keys by slot."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = PerfectHash.of_row(row | {"sizes": [], "words": b"", "alone": 0}).keys.cast(pa.large_string()).cast(pa.string())
                for at in range(0, len(keys), 65536):
                    part = keys.slice(at, 65536)
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * n, pa.string()), pa.array([row["shard"]] * n, pa.int32()),
                                                      pa.array(np.arange(at, at + n), pa.int32()), part], names=["lang", "shard", "idx", "item"])
    return shards.select("lang", "shard", "lengths", "key_bytes").mapInArrow(spell, "lang string, shard int, idx int, item string")
