"""Quality of extraction: sections of a reference, multisets of amounts, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import money_values
from ..functions.text import flagged

FOLIO_MARK = r"Fls\.:\s*(\d+)"  # fixed value


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fls, section): the text from each folio mark to the next; a later mark with the same number wins."""
    mark = flagged(FOLIO_MARK, "i")
    parts = F.filter(F.split(F.col(text), "(?i)(?=Fls\\.:\\s*\\d)", -1), lambda p: p.rlike("^" + FOLIO_MARK) | p.rlike("(?i)^Fls\\.:\\s*\\d"))
    each = df.select(key, F.posexplode(parts).alias("_pos", "section")).withColumn("fls", F.regexp_extract("section", mark, 1).cast("long"))
    return each.groupBy(key, "fls").agg(F.max_by("section", "_pos").alias("section"))


def money_recall(reference: DataFrame, extracted: DataFrame, key: str, ref_text: str, ext_text: str) -> DataFrame:
    """(key, n_reference, n_hit, recall): share of the reference's amounts, as a multiset, that the extraction has."""
    count = lambda df, text, n: df.select(key, F.explode(money_values(F.col(text))).alias("value")).groupBy(key, "value").agg(F.count("*").alias(n))
    a, b = count(reference, ref_text, "_r"), count(extracted, ext_text, "_e")
    hits = a.join(b, [key, "value"], "left").groupBy(key).agg(F.sum("_r").alias("n_reference"), F.sum(F.least("_r", F.coalesce("_e", F.lit(0)))).alias("n_hit"))
    out = reference.select(key).distinct().join(hits, key, "left").fillna(0, ["n_reference", "n_hit"])
    return out.select(key, "n_reference", "n_hit", F.when(F.col("n_reference") == 0, 1.0).otherwise(F.col("n_hit").cast("double") / F.col("n_reference")).alias("recall"))
