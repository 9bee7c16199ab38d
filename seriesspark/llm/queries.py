"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, line_dedup, mixing, near_dup, packing, pii, quality, substring, token_files, warc_zip, whitening
from .common import table
from .oracles import ORACLES  # noqa: F401  (re-exported)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.pareto_mix(docs, mixing.word_count(F.col("text")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_tokens(manifest)


# A conversation whose texts hold the template's control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    out = chat.format_chats(turns.unionByName(probe), chat.text_part(F.col("text")))
    read = F.array_join(F.transform(chat.read_turns(F.col("formatted")),
                                    lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("_loss", chat.read_loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select("conv_id", F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
                      F.sha2(read, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
                      F.sha2("_loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write_archives(table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(manifest, payload=False).drop("url")


def op8_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


PII_KEY = "surrogates of this corpus"  # a deployment sets its own


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op10_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_hyperminhash": op4_hyperminhash,
    "op5_token_files": op5_token_files,
    "op6_chat_format": op6_chat_format,
    "op7_warc_archives": op7_warc_archives,
    "op8_substring_doubling": op8_substring_doubling,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_benchmark_index": op10_benchmark_index,
    "op11_source_divergence": op11_source_divergence,
    "op12_pack_windows": op12_pack_windows,
    "op13_whitening": op13_whitening,
}
