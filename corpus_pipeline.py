"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard groups, benchmark decontamination, tokenization.

Each stage takes all that its predecessor kept, as a table, and returns the columns of ``documents``; the last one returns
the ids of the pieces instead of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontam, line_dedup, ngram_join, quality_rules, sentencepiece_sa
from foliospark.llm.queries import tokenizer_file
from foliospark.llm.store import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_only(docs, rules)


def drop_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line blocks that an earlier document has; a document of which nothing is left goes."""
    out = line_dedup.drop_common_blocks(docs).where("n_removed_lines = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard similarity of their five-word n-grams (0.8 or more), the one with the smallest id."""
    groups = ngram_join.jaccard_groups(docs, n=5, num=80, den=100)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return sentencepiece_sa.encode(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_blocks),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", tokenize),
]
#: SQL can't express the learned rules, the alignment or the encoder; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
