"""Set operators before and around a run: the queue of files, images by file index, labels with values below, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flow import logo_file
from ..functions.stamps import signature_ids, squeeze, stamp_ids
from ..functions.text import bound, filled_lines, strip


def resolved(path: Column) -> Column:
    """A path without repeated slashes and ``.`` steps."""
    return F.regexp_replace(F.regexp_replace(path, "/(?:\\./)+", "/"), "/{2,}", "/")


def queue(files: DataFrame) -> DataFrame:
    """(path, place) of the PDF files of (path, place): one row a resolved path, at its first place."""
    pdf = files.select(resolved(F.col("path")).alias("path"), "place").where(F.lower("path").endswith(".pdf"))
    return pdf.groupBy("path").agg(F.min("place").alias("place"))


def missing(queued: DataFrame, listing: DataFrame) -> DataFrame:
    """Queued paths that a listing lacks; a run starts only if there are none."""
    return queued.join(listing.select(resolved(F.col("path")).alias("path")).distinct(), "path", "left_anti")


def image_of_file(files: DataFrame, images: DataFrame) -> DataFrame:
    """Files (page_no, file_name) with ``num``: the image row with the file's index, else the one with the next number."""
    index = F.regexp_extract("file_name", r"-(\d+)(?:\.[^.]*)?$", 1).try_cast("long")
    known = images.select("page_no", F.col("num").cast("long").alias("num"))
    each = files.withColumn("_i", index)
    hits = each.join(known.withColumnRenamed("num", "_a"), (each["page_no"] == known["page_no"]) & (F.col("_i") == F.col("_a")), "left").drop(known["page_no"])
    later = known.select(F.col("page_no").alias("_p"), F.col("num").alias("_b"))
    return hits.join(later, (F.col("page_no") == F.col("_p")) & (F.col("_i") + 1 == F.col("_b")), "left").select(*files.columns, F.coalesce("_a", "_b").alias("num"))


def values_below(df: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """(key, label, value): labels alone on a line with the next line's text, unless that is a label too; the first of a label."""
    def label_of(line: Column) -> Column:
        # the longest label first, then by name
        named = lambda bare: F.coalesce(*[F.when(bare == x.lower(), x) for x in sorted(set(labels), key=lambda x: (-len(x), x))], F.lit(None).cast("string"))
        return bound(F.lower(F.regexp_replace(line, "^[ :]+|[ :]+$", "")), named)

    def pairs(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct(i.alias("i"), label_of(x).alias("label"), strip(F.get(lines, i + 1)).alias("value")))

    each = df.select(key, F.explode(F.filter(bound(filled_lines(F.col(text)), pairs), lambda p: p["label"].isNotNull() & p["value"].isNotNull() & label_of(p["value"]).isNull())).alias("_p"))
    return each.groupBy(key, F.col("_p.label").alias("label")).agg(F.min_by("_p.value", "_p.i").alias("value"))


def page_ids(explicit: Column, text: Column) -> Column:
    """Signatures of a page: those given, else those that its text shows."""
    found = F.array_distinct(F.concat(signature_ids(text), stamp_ids(text)))
    return F.when(F.size(F.coalesce(explicit, F.array().cast("array<string>"))) > 0, F.array_distinct(F.transform(explicit, F.lower))).otherwise(found)


def interleaved(paragraphs: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, text): paragraphs and figure texts (y, x, text) in reading order."""
    both = paragraphs.select(key, "y", "x", F.lit(0).alias("_k"), strip(F.col("text")).alias("text")).unionByName(figures.select(key, "y", "x", F.lit(1).alias("_k"), strip(F.col("text")).alias("text"))).where("text <> ''")
    items = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "_k", "text"))).alias("_b"))
    return items.select(key, squeeze(F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n")).alias("text"))


def folio_pages(pages: DataFrame) -> DataFrame:
    """(pdf_id, fls, page_no): the first page that shows each folio."""
    return pages.where("fls IS NOT NULL").groupBy("pdf_id", "fls").agg(F.min("page_no").alias("page_no"))


def index_pages(pages: DataFrame, marker: str, last: int = 40) -> DataFrame:
    """Pages to read an index from: the last ones of a document if one of them has the marker, else all."""
    whole = Window.partitionBy("pdf_id")
    late = F.col("page_no") > F.max("page_no").over(whole) - last
    told = F.max(F.when(late, F.col("text").contains(marker)).otherwise(False)).over(whole)
    return pages.withColumn("_late", late).withColumn("_told", told).where("_late OR NOT _told").drop("_late", "_told")


def content_files(files: DataFrame, images: DataFrame, least: int = 2048) -> DataFrame:
    """Image files (page_no, file_name, n_bytes, file_width, file_height; null sizes: unreadable) that show content, with ``num``.

    Files of under ``least`` bytes go. The image row of a file's index (page_no, num, content) decides; a file without one stays
    unless it looks like a logo by itself.
    """
    known = images.select("page_no", F.col("num").cast("long").alias("num"), F.coalesce("content", F.lit(False)).alias("_content"))
    each = image_of_file(files.where(F.col("n_bytes") >= least), known).join(known, ["page_no", "num"], "left")
    keep = F.when(F.col("_content").isNotNull(), F.col("_content")).otherwise(~logo_file(F.col("file_width"), F.col("file_height"), F.col("n_bytes")))
    return each.where(keep).select(*files.columns, "num")
