"""The queries, each over its whole table with production parameters, and their DuckDB SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, filter_audit, language_id, line_dedup, ngram_join, oracles, periodic_runs, pii, quality_rules, secrets, sentencepiece_sa, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies: in the folder that ``FOLIOSPARK_TOKENIZERS`` names, else the installed one."""
    return os.path.join(os.environ.get("FOLIOSPARK_TOKENIZERS", "/opt/tokenizers"), name)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, key="corpus-key-1")
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.written("base"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("long").alias("rule"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 judges by, without the learned list, which SQL can't express."""
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse_and_render(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pii_pseudonyms, op6_url_filter, op7_secret_scan, op8_quality_rules, quality_statistics, op10_chat_collapse)}


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


QUERIES["op9_ngram_jaccard"] = op9_ngram_jaccard


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op3_suffix_dedup"] = op3_suffix_dedup


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op4_decontamination"] = op4_decontamination


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_blocks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed_lines")


QUERIES["op2_line_dedup"] = op2_line_dedup


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_sa.encode(docs, tokenizer_file("piece_bpe_32k.model"), verify=True)
    return out.select("doc_id", "n_tokens", "ids", "round_trip")


QUERIES["op5_sentencepiece"] = op5_sentencepiece


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out().alias("held_out"))
    profiles = language_id.fit(docs.where("NOT held_out"))
    return language_id.predict(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES["op11_language_id"] = op11_language_id


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.summary(periodic_runs.periodic_runs(docs, least=6, power=4))


QUERIES["op12_periodic_runs"] = op12_periodic_runs


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op13_filter_audit"] = op13_filter_audit


ORACLES = {
    "op3_suffix_dedup": oracles.REPEATS, "op6_url_filter": oracles.URLS, "op7_secret_scan": oracles.SECRETS, "quality_statistics": oracles.STATISTICS, "op9_ngram_jaccard": oracles.NGRAMS, "op10_chat_collapse": oracles.CHAT,
    "op11_language_id": oracles.LANGUAGES, "op12_periodic_runs": oracles.RUNS, "op13_filter_audit": oracles.AUDIT,
}
