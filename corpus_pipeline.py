"""The corpus pipeline: quality, line dedup, near duplicates, benchmark passages, then encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns the columns of
documents; the last returns the digests of op8. Between stages a table is written and read again.

Every stage but the last keeps rows as they are, columns beside those of documents among them, and only drops some (or, in
line dedup, shortens texts). Rows without an id are never dropped by their id; rows of one repeated id stay or go together
where a stage decides by id. Null and empty texts have no lines, words or passages: only the quality score of such texts
decides about them. Ties go to the least id. Very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from tidemark.llm.registry import RANKS
from tidemark.llm.shared import WorkTables, broadcast_if_small, table

#: Ids of removed documents are broadcast up to so many (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: The stages make no single SQL query (a learnt classifier, MinHash, BPE); tests hold them against plain Python.
ORACLE_SQL = None


def _without(docs: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    """docs without the ids in removed; rows without an id stay."""
    ids = WorkTables(docs.sparkSession, name).keep(removed.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(broadcast_if_small(ids, BROADCAST_IDS), F.col("doc_id") == F.col("_gone"), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have the score of the labelled rows' mean; without any
    labels all stay."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("quality_predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-equal lines go; so do documents of which nothing but blanks is left by that. A document that had
    nothing to lose stays, empty or null as it may be. Rows of one repeated id lose the same places."""
    left = line_dedup.dedup_lines(docs)
    left = left.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Texts without words are in no group."""
    found = ngram_join.join_ngrams(docs)
    return _without(docs, found.where("component_id <> doc_id"), "ngram_stage")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; an empty benchmark drops none."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), "decontaminate_stage")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row that is left; null texts count as empty."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("byte_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    work = WorkTables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
