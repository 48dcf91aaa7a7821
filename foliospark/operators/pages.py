"""Set operators over pages: letterheads, signature groups, index lookup, runs, assembly, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import banners, pages
from ..functions.stamps import squeeze
from ..functions.text import bound, flagged, lines, norm_line, strip, text_of


def band_chrome(df: DataFrame, text: str = "residual_text", read: banners.Read = flagged) -> DataFrame:
    """(pdf_id, page_no, line_no, norm, header, footer, banner, contact) of the lines in a page's bands that are banners or contacts.

    Bands are counted over lines with text: a third of them at each end up to 16, else eight and eight. A page's lines are judged
    in one expression, so that each is folded once, only lines short enough are matched, and only those found become rows.
    """
    kind = "struct<line_no:int,norm:string,header:boolean,footer:boolean,banner:boolean,contact:boolean>"

    def judged(x: Column, header: Column, footer: Column) -> Column:
        one = lambda norm: F.struct(x["line_no"].alias("line_no"), norm.alias("norm"), header.alias("header"), footer.alias("footer"), banners.banner(x["line"], read).alias("banner"), banners.contact(x["line"], read).alias("contact"))
        return bound(norm_line(x["line"]), lambda norm: F.when(F.length(norm) <= banners.LONGEST, one(norm)).otherwise(F.lit(None).cast(kind)))

    def in_bands(filled: Column) -> Column:
        n = F.size(filled)
        band = F.when(n <= 16, F.greatest(F.lit(1), F.floor(n / 3).cast("int"))).otherwise(8)
        ends = lambda k: F.filter(F.transform(filled, lambda x, i: F.when((i < k) | (i >= n - k), judged(x, i < k, i >= n - k))), lambda x: x["banner"] | x["contact"])
        return bound(band, ends)

    numbered = F.transform(lines(F.col(text)), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    found = bound(F.filter(numbered, lambda x: strip(x["line"]) != ""), in_bands)
    return df.select("pdf_id", "page_no", F.explode(found).alias("_l")).select("pdf_id", "page_no", "_l.*")


def repeated_lines(chrome: DataFrame, least: int = 3) -> DataFrame:
    """(band, pdf_id, norm, n_pages) of banner lines of ``band_chrome`` that a band of at least ``least`` pages has."""
    bands = F.array_compact(F.array(*[F.when(F.col(b), b) for b in ("header", "footer")]))
    votes = chrome.where("banner").select(F.explode(bands).alias("band"), "pdf_id", "page_no", "norm").distinct()
    return votes.groupBy("band", "pdf_id", "norm").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)


def strip_letterheads(df: DataFrame, least: int = 3, text: str = "residual_text", exempt: Column | None = None, read: banners.Read = flagged) -> DataFrame:
    """(pdf_id, page_no, residual_text) without contact lines and repeated banners of the bands; exempt pages vote but stay whole.

    Only the numbers of lines travel to be counted; the texts meet the numbers of the lines that go."""
    same = Window.partitionBy("pdf_id", "norm")
    pages_with = lambda band: F.size(F.collect_set(F.when(F.col(band) & F.col("banner"), F.col("page_no"))).over(same))
    voted = band_chrome(df, text, read).withColumn("_header", pages_with("header") >= least).withColumn("_footer", pages_with("footer") >= least)
    goes = (F.col("header") & ((F.col("banner") & F.col("_header")) | F.col("contact"))) | (F.col("footer") & ((F.col("banner") & F.col("_footer")) | F.col("contact")))
    gone = voted.where(goes).groupBy("pdf_id", "page_no").agg(F.collect_list("line_no").alias("_gone"))
    left = F.array_join(F.filter(lines(F.col("_text")), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    base = df.select("pdf_id", "page_no", F.col(text).alias("_text"), (exempt if exempt is not None else F.lit(False)).alias("_exempt"))
    kept = F.when(F.col("_exempt"), F.col("_text")).otherwise(squeeze(F.when(F.col("_gone").isNull(), text_of(F.col("_text"))).otherwise(left)))
    return base.join(gone.hint("merge"), ["pdf_id", "page_no"], "left").select("pdf_id", "page_no", kept.alias("residual_text"))


def keep_signature(df: DataFrame, ids: str = "signature_ids") -> DataFrame:
    """Adds ``keep_signature``: whether the next page has another set of signatures; the last page of a group keeps its own."""
    mine = F.sort_array(F.array_distinct(F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), F.lower)))
    following = F.coalesce(F.lead(F.col("_ids")).over(Window.partitionBy("pdf_id").orderBy("page_no")), F.array().cast("array<string>"))
    return df.withColumn("_ids", mine).withColumn("keep_signature", (F.size("_ids") > 0) & (F.col("_ids") != following)).drop("_ids")


def index_lookup(df: DataFrame, index: DataFrame, ids: str = "signature_ids") -> DataFrame:
    """(pdf_id, page_no, doc_id, tipo, titulo) of the index row that speaks for each page: forms first, then acts that are
    neither generic nor petitions, then those not generic, then the first signature."""
    tipo, titulo = F.col("tipo"), F.col("titulo")
    rank = F.when(pages.forced_form(tipo, titulo), 0).when(~pages.generic(tipo) & ~pages.petition_like(tipo), 1).when(~pages.generic(tipo), 2).otherwise(3)
    each = df.select("pdf_id", "page_no", F.posexplode(F.transform(ids, F.lower)).alias("_pos", "doc_id"))
    hit = each.join(index, ["pdf_id", "doc_id"]).withColumn("_rank", rank)
    best = hit.groupBy("pdf_id", "page_no").agg(F.min_by(F.struct("doc_id", "tipo", "titulo"), F.struct("_rank", "_pos")).alias("_b"))
    return df.select("pdf_id", "page_no").join(best, ["pdf_id", "page_no"], "left").select("pdf_id", "page_no", "_b.doc_id", "_b.tipo", "_b.titulo")


def image_runs(df: DataFrame, size: int = 4) -> DataFrame:
    """(pdf_id, page_no, run, chunk) of consecutive image pages, cut into chunks of ``size``."""
    order = Window.partitionBy("pdf_id").orderBy("page_no")
    run = df.where(F.col("page_class") == "image_page").select("pdf_id", "page_no", (F.col("page_no") - F.row_number().over(order)).alias("run"))
    within = Window.partitionBy("pdf_id", "run").orderBy("page_no")
    return run.select("pdf_id", "page_no", F.col("run").cast("long").alias("run"), F.floor((F.row_number().over(within) - 1) / size).cast("long").alias("chunk"))


def document_statistics(df: DataFrame) -> DataFrame:
    """One row a document from its pages (page_class, has_tables, ocr_failed, word_count, char_count, processing_time)."""
    count = lambda c: F.count_if(c).cast("long")
    seconds = F.sum("processing_time")
    n = F.count("*")
    return df.groupBy("pdf_id").agg(
        n.alias("total_pages"),
        count(F.col("page_class") == "native").alias("native_pages"),
        count(F.col("page_class") == "hybrid").alias("hybrid_pages"),
        count(F.col("page_class") == "image_page").alias("image_pages"),
        count(F.col("has_tables")).alias("pages_with_tables"),
        count(F.col("ocr_failed")).alias("ocr_failed_pages"),
        F.sum("word_count").cast("long").alias("total_words"),
        F.sum("char_count").cast("long").alias("total_characters"),
        F.round(F.coalesce(F.try_divide(seconds, n), F.lit(0.0)), 2).alias("avg_time_per_page"),
    )


def page_section(page_no: Column, fls: Column, body: Column, failed: Column, reason: Column) -> Column:
    """Markdown of one page: title with its folio, a note where recognition failed, and the body or what stands for it."""
    title = F.concat(F.lit("## Página "), page_no.cast("string"), F.coalesce(F.concat(F.lit(" — Fls.: "), fls.cast("string")), F.lit("")))
    note = F.when(failed, F.concat(F.lit("\n\n> **OCR falhou**: `"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("ocr_failed")), F.lit("`"))).otherwise("")
    empty = F.when(failed, "*Nenhum texto utilizável após falha de OCR.*").otherwise("*Nenhum texto extraído desta página*")
    return F.concat(title, note, F.lit("\n\n"), bound(body, lambda b: F.when(b == "", empty).otherwise(b)))


def markdown(df: DataFrame) -> DataFrame:
    """One Markdown text a document from its pages (pdf_id, page_no, fls, body, ocr_failed, ocr_failure_reason)."""
    section = page_section(F.col("page_no"), F.col("fls"), F.col("body"), F.col("ocr_failed"), F.col("ocr_failure_reason"))
    parts = df.select("pdf_id", "page_no", section.alias("_s")).groupBy("pdf_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "_s"))).alias("_p"))
    return parts.select("pdf_id", F.concat(F.lit("# "), F.col("pdf_id"), F.lit("\n\n"), F.array_join(F.transform("_p", lambda x: x["_s"]), "\n\n")).alias("markdown"))
