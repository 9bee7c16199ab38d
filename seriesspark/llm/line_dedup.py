"""Line dedup with keep bitmaps.

Long line keys are hashed to 128 bits, range-partitioned by hash and sorted
within it by document and position. Streaming over each run of equal hashes, the
first document keeps its lines; the decision for every other row is a bit. What
comes back per document is a sparse bitmap: 64-line words that have at least one
dropped line. Words that are absent keep all their lines.

A line shared by a large part of all documents is split by a salt of the
document: within one (hash, salt) run a row that already has ``min_docs`` larger
documents before it is dropped at once, so at most ``min_docs`` documents per
salt reach the second pass, whose runs are whole.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` is the
smallest document; rows that repeat a ``doc_id`` are one document, and rows that
repeat both id and text get the same bitmap; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, materialize, partitions


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, f"^{BLANKS}|{BLANKS}$", ""))


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, text_hash, words`` for documents that lose lines.

    ``words`` is ``array<struct<word int, keep bigint>>`` in ascending order; bit
    ``b`` of word ``w`` tells whether line ``64 * w + b`` stays.
    """
    n = partitions(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                    F.transform(text_lines(F.col(text)), line_key).alias("keys"))
    lines = d.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "k")) \
        .where(F.length("k") >= min_chars) \
        .select("doc_id", "text_hash", "pos", F.xxhash64("k").alias("h1"),
                F.xxhash64(F.lit("second"), "k").alias("h2"))
    lines = materialize(lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")), "lines")
    newest = F.col("doc_id").desc_nulls_last()
    part = lines.repartitionByRange(n, "h1", "h2", "salt")
    part = part.withColumn("_rank", F.dense_rank().over(Window.partitionBy("h1", "h2", "salt").orderBy(newest)))
    part = materialize(part, "runs")
    sure = part.where(F.col("_rank") > min_docs)
    whole = Window.partitionBy("h1", "h2")
    rest = part.where(F.col("_rank") <= min_docs).repartitionByRange(n, "h1", "h2") \
        .withColumn("_rank", F.dense_rank().over(whole.orderBy(newest)))
    rest = rest.withColumn("_docs", F.max("_rank").over(whole)) \
        .where((F.col("_docs") >= min_docs) & (F.col("_rank") >= 2)).drop("_docs")
    dropped = sure.unionByName(rest)
    words = dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))).alias("_drop"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("_drop").alias("keep")))).alias("words"))


def dropped_positions(words: Column) -> Column:
    """The cleared bits of a bitmap, ascending (null bitmap: none)."""
    def of_word(w: Column) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["keep"], b) == 0)
        return F.transform(bits, lambda b: w["word"] * 64 + b)
    return F.coalesce(F.flatten(F.transform(words, of_word)), F.array().cast("array<int>"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """Apply the bitmaps: ``doc_id, n_lines, n_dropped, kept`` (the text left)."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    maps = keep_bitmaps(docs, **options).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    d = d.join(maps, d["doc_id"].eqNullSafe(F.col("_id")) & (d["text_hash"] == F.col("_hash")), "left")
    lines = text_lines(F.col("text"))
    n = F.size(lines)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), dropped_positions(F.col("words")))
    kept_text = F.transform(F.array(F.struct(lines.alias("l"), kept.alias("p"))),
                            lambda s: F.array_join(F.transform(s["p"], lambda i: s["l"][i]), "\n"))[0]
    n_dropped = F.coalesce(F.aggregate("words", F.lit(0), lambda a, w: a + 64 - F.bit_count(w["keep"])), F.lit(0))
    return d.select("doc_id", n.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"),
                    F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text).alias("kept"))
