"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next one's ``docs``. All but the last return the
columns of ``docs``; further columns, also ones named like a measurement, are
carried through.

Defined cases: a null text has no words and fails the quality rules; rows that
repeat a ``doc_id`` and its text are one document for near-dedup and one of them
stays, other texts under the same id are documents of their own; a null
``doc_id`` is never a duplicate; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesspark.llm import decontam, mixing, near_dup, quality, token_files
from seriesspark.llm.common import materialize, table
from seriesspark.llm.queries import tokenizer_path

ROW_KEY, CHECK = "_row_key", "_row_check"


def _keyed(docs: DataFrame) -> DataFrame:
    """Every row with two 64-bit hashes of its id and text, never null: a key, and a second one that tells rows apart whose keys clash."""
    return docs.withColumns({ROW_KEY: F.xxhash64("doc_id", "text"), CHECK: F.xxhash64(F.lit("row"), "text", "doc_id")})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 rejects go."""
    rows = docs.select(F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    rows = quality.apply_policy(quality.ledger(rows, text="_text", carry=("_row",)), "v2")
    return rows.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    keyed = _keyed(docs).withColumn(ROW_KEY, F.when(F.col("doc_id").isNotNull(), F.col(ROW_KEY)))
    group = near_dup.near_duplicates(keyed, key=ROW_KEY, shingle=5, percent=80) \
        .where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(ROW_KEY), "component_id").distinct()
    ids = materialize(keyed.select(ROW_KEY, "doc_id").join(group, ROW_KEY).distinct(), "groups")
    # a written table: a component of any size can then be split when its rows meet it
    first = materialize(ids.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW_KEY))[ROW_KEY].alias("_first")), "first-rows")
    gone = ids.join(first, "component_id").where(F.col(ROW_KEY) != F.col("_first")).select(F.col(ROW_KEY).alias("_gone"))
    left = keyed.join(gone, F.col(ROW_KEY) == F.col("_gone"), "left_anti")
    # repeated rows: one stays, by partial aggregates over the rows that repeat; rows without an id all stay
    same = [ROW_KEY, CHECK]
    often = materialize(left.where(F.col(ROW_KEY).isNotNull()).groupBy(*same).agg(F.count("*").alias("_n")).where("_n > 1").select(*same), "repeated-rows")
    once = left.join(often, same, "left_anti").select(*docs.columns)
    one = left.join(often, same, "left_semi").groupBy(*same).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return once.unionByName(one.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed = _keyed(docs)
    hits = decontam.contamination(keyed, table(spark, sf_dir, "benchmark"), key=ROW_KEY).where("n_hit > 0") \
        .select(F.col("doc_id").alias(ROW_KEY)).distinct()
    return keyed.join(hits, ROW_KEY, "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    keyed = _keyed(docs)
    mix = mixing.pareto_mix(keyed, mixing.word_count(F.col("text")), key=ROW_KEY, carry=(CHECK,))
    copies = mix.groupBy(F.col("doc_id").alias(ROW_KEY), CHECK).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    one = keyed.dropDuplicates([ROW_KEY, CHECK]).join(copies, [ROW_KEY, CHECK])
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document with its place and checksum."""
    return token_files.read_tokens(token_files.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

# Near-dedup and tokenization are not SQL: tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
