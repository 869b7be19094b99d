"""The numbered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, language_id, licenses, line_dedup, ngram_join, oracles, prefix_trie, quality, repeats, secrets, spelling, word_bpe
from .shared import WorkTables, held_out, table

#: The rank file of op8 and of the pipeline; a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer file of op12; a parameter of the operator.
WORDS = "word_bpe_49k.json"


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, below it one for 1000 ids, below that one for 20."""
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), folder(1000), folder(20), F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(docs).withColumn("own_score", F.round("own_score", 6))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "lines_total", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = WorkTables(spark, "conversations").keep(prefix_trie.conversations(table(spark, sf_dir, "conversations")))
    return prefix_trie.build(prefix_trie.with_shared_heads(own))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe.read_tokenizer(public_tokenizers.path(WORDS)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters as words; of every run whose crc32 97 divides one letter is deleted, so that there are variants."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    return spelling.group_variants(spelling.count_words(spelling.with_planted_slips(runs)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": oracles.OP3, "op11_prefix_trie": oracles.OP11, "op13_spelling": oracles.OP13}
