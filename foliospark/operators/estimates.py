"""Lookup of a token estimate among the files beside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import last_estimate


def document_stem(name: Column) -> Column:
    """A file's name without suffix, and without what marks a sanitised copy."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    at = F.instr(F.lower(stem), "_full_sanitized")
    return F.when(at > 1, F.regexp_replace(F.substr(stem, F.lit(1), at - 1), "_+$", "")).otherwise(stem)


def find_estimates(pdfs: DataFrame, files: DataFrame) -> DataFrame:
    """(pdf_id, sanitized, log, openai, gemini, outcome): the newest sanitised copy, and the newest log that holds an estimate."""
    p = pdfs.select("pdf_id", "folder", F.lower(document_stem(F.col("name"))).alias("_stem"))
    f = files.select("folder", F.col("name").alias("file"), "mtime", "content", F.lower("name").alias("_low"))
    # a file belongs to each stem that ends before one of its underscores: a join by equal keys, not over all files of a folder
    parts = F.split("_low", "_", -1)
    stems = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    near = p.join(f.select("*", F.explode(F.array_distinct(stems)).alias("_stem")), ["folder", "_stem"])
    clean = F.col("_low").startswith(F.concat("_stem", F.lit("_full_sanitized")))
    log = F.col("_low").endswith(".txt") & F.col("_low").contains("log_split") & F.col("_low").startswith(F.concat("_stem", F.lit("_")))
    told = near.withColumn("_o", F.when(log, last_estimate(F.col("content"), "openai"))).withColumn("_g", F.when(log, last_estimate(F.col("content"), "gemini")))
    newest = lambda c, when: F.max_by(c, F.when(when, F.struct("mtime", "file")))
    with_estimate = log & F.col("_o").isNotNull()
    best = told.groupBy("pdf_id").agg(
        newest("file", clean).alias("sanitized"), F.count_if(clean).alias("_c"), F.count_if(log).alias("_l"), newest("file", with_estimate).alias("_log"), newest("_o", with_estimate).alias("_o"), newest("_g", with_estimate).alias("_g"), F.count_if(with_estimate).alias("_e"),
    )
    out = pdfs.select("pdf_id").join(best, "pdf_id", "left").fillna(0, ["_c", "_l", "_e"])
    outcome = F.when(F.col("_c") == 0, "no sanitised copy").when(F.col("_e") > 0, "estimate").when(F.col("_l") > 0, "log without estimate").otherwise("no log")
    hit = (F.col("_c") > 0) & (F.col("_e") > 0)
    return out.select("pdf_id", F.when(F.col("_c") > 0, F.col("sanitized")).alias("sanitized"), F.when(hit, F.col("_log")).alias("log"), F.when(hit, F.col("_o")).alias("openai"), F.when(hit, F.col("_g")).alias("gemini"), outcome.alias("outcome"))
