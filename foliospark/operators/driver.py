"""The page driver as columns: what an engine recognised on a page goes down a ladder of branches and fallbacks.

Engines and models stay outside. Their outputs are input columns; a null stands for an engine that was not asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow, stamps
from ..functions.formatters import formatted
from ..functions.pages import kind_of_text, ocr_usable
from ..functions.reports import caption_block, with_details
from ..functions.text import strip, text_of, word_count
from .figures import duplicate_text, merge_figures

# fixed values: kinds with a form, the least size of a figure's file, the place of a figure without one
FORM_KINDS = ("trct", "cd_sd", "ficha_registro", "recibo", "fgts", "cnh", "identidade", "ctps")
FIGURE_BYTES = 3000
UNPLACED = 10_000.0


def _filled(c: Column) -> Column:
    return strip(text_of(c)) != ""


def _tables(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def structured(template: Column, kind: Column, transcript: Column, ocr_text: Column) -> Column:
    """struct<ok,markdown,source,fill_ratio,n_table_rows>: a template's result (ok, markdown, kind, fill_ratio, n_table_rows) that
    is good, else a model's transcript of a page of a form's kind, else the template's result as it is."""
    told = F.coalesce(template["kind"], kind).isin(*FORM_KINDS) & _filled(transcript)
    own = F.struct(template["ok"].alias("ok"), template["markdown"].alias("markdown"), F.lit("template").alias("source"), template["fill_ratio"].alias("fill_ratio"), template["n_table_rows"].alias("n_table_rows"))
    other = F.struct(F.lit(True).alias("ok"), with_details(strip(transcript), ocr_text).alias("markdown"), F.lit("vlm").alias("source"), F.lit(1.0).alias("fill_ratio"), F.lit(0).alias("n_table_rows"))
    return F.when(F.coalesce(template["ok"], F.lit(False)), own).when(told, other).when(template.isNotNull(), own)


def template_result(kind: Column, ocr_text: Column, markdown: Column, fill_ratio: Column, n_table_rows: Column, least: float = 0.45) -> Column:
    """struct<kind,ok,markdown,reason,fill_ratio,n_table_rows> of a template that was filled from a page's text."""
    known, text = kind.isin(*FORM_KINDS), _filled(ocr_text)
    good = F.coalesce(known & text & (fill_ratio >= least) & _filled(markdown), F.lit(False))
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown_kind").when(~text, "empty_ocr")
    return F.struct(kind.alias("kind"), good.alias("ok"), F.when(reason.isNull(), with_details(markdown, ocr_text)).otherwise("").alias("markdown"), reason.alias("reason"), F.when(reason.isNull(), fill_ratio).otherwise(0.0).alias("fill_ratio"), F.when(reason.isNull(), n_table_rows).otherwise(0).alias("n_table_rows"))


def native_pages(df: DataFrame) -> DataFrame:
    """Adds ``text`` and ``kind`` to pages (residual_text, doc_kind) with a text layer: the page's kind, or its text's, lays it out."""
    body = df.withColumn("_body", strip(text_of(F.col("residual_text")))).withColumn("kind", F.coalesce(F.nullif("doc_kind", F.lit("")), kind_of_text(F.col("_body"))))
    return body.withColumn("text", F.when(F.col("kind").isNotNull(), formatted(F.col("_body"), F.col("kind"))).otherwise(F.col("_body"))).drop("_body")


def figure_texts(figures: DataFrame, key: str) -> DataFrame:
    """Figures (size, logo, banner, covered, body, ocr_text, tables, caption, y, x) of hybrid pages that add something to the body,
    with ``block`` and ``described``: recognised text that the body lacks, else a caption."""
    seen = figures.where((F.col("size") >= FIGURE_BYTES) & ~F.coalesce("logo", F.lit(False)) & ~F.coalesce("banner", F.lit(False)) & ~F.coalesce("covered", F.lit(False)))
    each = seen.withColumn("_usable", ocr_usable(F.col("ocr_text")))
    fresh = duplicate_text(each.where("_usable"), "ocr_text", "body").where("NOT duplicate").drop("duplicate")
    read = fresh.withColumn("block", formatted(F.col("ocr_text"), kind_of_text(F.col("ocr_text")), F.col("tables"))).withColumn("described", F.lit(False))
    shown = each.where(~F.col("_usable") & _filled(F.col("caption"))).withColumn("block", caption_block(F.col("caption"), F.lit(None).cast("int"))).withColumn("described", F.lit(True))
    out = read.unionByName(shown)
    return out.select(key, F.coalesce(F.col("y").cast("double"), F.lit(UNPLACED)).alias("y"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), "block", "described")


def hybrid_pages(pages: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, text, has_tables, images_described) of hybrid pages (key, body, height): figures stand at their places if one has a
    place, else below the body, where a block that the body has already is left out."""
    blocks = figure_texts(figures.join(pages.select(key, "body"), key), key)
    facts = blocks.groupBy(key).agg((F.min("y") < 9000).alias("_placed"), F.count_if("described").alias("images_described"), F.max(F.col("block").contains("|")).alias("has_tables"))
    known = pages.join(facts, key, "left")
    placed = known.where("_placed").select(key, "body", "height")
    merged = merge_figures(placed, blocks.join(placed.select(key), key, "left_semi").select(key, "y", "x", F.col("block").alias("caption")), key).select(key, F.col("body").alias("_merged"))
    loose = duplicate_text(blocks.join(known.where("NOT _placed").select(key, F.col("body").alias("_own")), key), "block", "_own").where("NOT duplicate")
    below = loose.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "block"))), lambda b: b["block"]), "\n\n").alias("_below"))
    text = F.coalesce(F.nullif("_merged", F.lit("")), F.concat_ws("\n\n", F.nullif(text_of(F.col("body")), F.lit("")), F.nullif("_below", F.lit(""))))
    return known.join(merged, key, "left").join(below, key, "left").select(key, strip(text).alias("text"), F.coalesce("has_tables", F.lit(False)).alias("has_tables"), F.coalesce("images_described", F.lit(0)).cast("long").alias("images_described"))


def page_figures(figures: DataFrame, key: str) -> DataFrame:
    """(key, text, images_described, has_tables) of image pages with two content figures or more (y, x, num, ocr_text, tables,
    caption): recognised text, else a caption, in visual order; captions are numbered where there are several."""
    page = Window.partitionBy(key)
    each = figures.withColumn("_n", F.count(F.lit(1)).over(page)).where("_n >= 2").withColumn("_read", F.when(ocr_usable(F.col("ocr_text")), F.nullif(strip(formatted(F.col("ocr_text"), kind_of_text(F.col("ocr_text")), F.col("tables"))), F.lit(""))))
    told = each.withColumn("_told", F.col("_read").isNull() & _filled(F.col("caption"))).withColumn("_several", F.count_if("_told").over(page) >= 2)
    order = page.orderBy("y", "x", "num")
    number = F.count_if("_told").over(order.rowsBetween(Window.unboundedPreceding, 0))
    block = F.coalesce("_read", F.when(F.col("_told"), caption_block(F.col("caption"), F.when(F.col("_several"), number).cast("int"))))
    rows = told.withColumn("_b", block)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("y", "x", "num", "_b")))), lambda r: r["_b"])
    tables = F.max(F.col("_read").isNotNull() & ((F.size(_tables(F.col("tables"))) > 0) | F.col("_read").contains("|")))
    return rows.groupBy(key).agg(strip(F.array_join(parts, "\n\n")).alias("text"), F.count_if("_told").alias("images_described"), tables.alias("has_tables"))


def image_pages(df: DataFrame, templates: bool = True) -> DataFrame:
    """Image pages with ``text``, ``kind``, ``fls``, ``source``, ``has_tables``, ``images_described``, ``ocr_failed`` and ``reason``.

    Input: doc_kind, forced, residual_text, fls; ocr_text, tables, ocr_error of the first pass; retry_text, retry_tables,
    retry_error of the retry on another engine (all null: none); second_text, second_tables of the pass for forms; filled
    (see ``structured``); caption of the page; figures struct<text,images_described,has_tables> (see ``page_figures``).
    """
    c = F.col
    failed, retried = c("ocr_error").isNotNull(), c("retry_text").isNotNull() | c("retry_error").isNotNull()
    out = df.withColumn("_reason", F.when(failed & ~retried, F.concat(F.lit("ocr_failed: "), c("ocr_error"))).when(failed & c("retry_error").isNotNull(), F.concat(F.lit("ocr_failed: "), c("retry_error"))))
    out = out.withColumn("_ocr", F.when(c("_reason").isNotNull(), "").when(failed, text_of(c("retry_text"))).otherwise(text_of(c("ocr_text"))))
    out = out.withColumn("_tables", F.when(c("_reason").isNotNull(), F.array().cast("array<string>")).when(failed, _tables(c("retry_tables"))).otherwise(_tables(c("tables"))))
    out = out.withColumn("_reason", F.coalesce("_reason", F.when(~_filled(c("_ocr")) & (F.size("_tables") == 0) & ~_filled(c("residual_text")), "empty_after_ocr")))
    out = out.withColumn("_body", F.coalesce(F.nullif(strip(c("_ocr")), F.lit("")), strip(text_of(c("residual_text")))))
    out = out.withColumn("kind", F.coalesce(flow.refined_kind(c("doc_kind"), c("_body")), kind_of_text(c("_body"))))
    # the largest folio that was read, unless the stamp has a larger one
    folio = F.array_max(F.concat(stamps.folios(c("_ocr")), stamps.folios(c("_body"))))
    out = out.withColumn("fls", F.when(folio.isNotNull() & (c("fls").isNull() | (folio >= c("fls"))), folio).otherwise(c("fls")))
    # the pass for forms counts if it has tables, or a text that is not much shorter
    form = F.coalesce(c("kind").isin(*FORM_KINDS), F.lit(False))
    more = form & (F.size("_tables") == 0) & ((F.size(_tables(c("second_tables"))) > 0) | ((F.length(text_of(c("second_text"))) > 0) & (F.length(text_of(c("second_text"))) >= F.length("_body") * 0.6)))
    out = out.withColumn("_more", more).withColumn("_body", F.when(c("_more") & _filled(c("second_text")), strip(c("second_text"))).otherwise(c("_body"))).withColumn("_tables", F.when(c("_more"), _tables(c("second_tables"))).otherwise(c("_tables")))
    asked = F.lit(templates) & (form | F.coalesce("forced", F.lit(False)))
    out = out.withColumn("_good", F.coalesce(asked & c("filled.ok") & _filled(c("filled.markdown")), F.lit(False)))
    out = out.withColumn("source", F.when(c("_good"), c("filled.source")).when(_filled(c("kind")), "labor_forms")).withColumn("_reason", F.when(~c("_good"), c("_reason")))
    out = out.withColumn("_body", F.when(c("_good"), strip(c("filled.markdown"))).when(_filled(c("kind")), formatted(c("_body"), c("kind"), c("_tables"))).otherwise(c("_body")))
    # a page without usable text is described, unless a form was filled: its figures if there are several, else the page
    done = (F.coalesce(c("source"), F.lit("")) == "vlm") | F.coalesce((c("source") == "template") & form, F.lit(False))
    bare = ~ocr_usable(c("_body")) & ~done
    out = out.withColumn("_figures", F.when(bare & c("figures").isNotNull(), c("figures"))).withColumn("_caption", F.when(bare & c("figures").isNull() & _filled(c("caption")), caption_block(c("caption"), F.lit(None).cast("int"))))
    by_figure = _filled(c("_figures.text"))
    described = by_figure & (c("_figures.images_described") > 0)
    return out.select(
        *[x for x in df.columns if x not in ("fls",)], "fls", "kind", F.when(by_figure, c("_figures.text")).otherwise(F.coalesce("_caption", "_body")).alias("text"),
        F.when(described | c("_caption").isNotNull(), "image_describe").otherwise(c("source")).alias("source"),
        ((F.size("_tables") > 0) | F.coalesce(c("_good") & (c("filled.n_table_rows") > 0), F.lit(False)) | F.coalesce(by_figure & c("_figures.has_tables"), F.lit(False))).alias("has_tables"),
        F.when(by_figure, c("_figures.images_described")).when(c("_caption").isNotNull(), 1).otherwise(0).cast("long").alias("images_described"),
        (c("_reason").isNotNull() & ~by_figure & c("_caption").isNull()).alias("ocr_failed"), F.when(~by_figure & c("_caption").isNull(), c("_reason")).alias("reason"),
    )


def settled(df: DataFrame) -> DataFrame:
    """Pages (text, residual_text, error, ocr_failed, reason) as rows of the run: a page with an error keeps its text layer and says
    why, and stops no other page. Adds ``word_count`` and ``char_count``."""
    broken = F.col("error").isNotNull()
    out = df.withColumn("text", F.when(broken, strip(text_of(F.col("residual_text")))).otherwise(text_of(F.col("text")))).withColumn("ocr_failed", broken | F.coalesce("ocr_failed", F.lit(False))).withColumn("reason", F.coalesce("error", "reason"))
    return out.withColumn("word_count", word_count(F.col("text"))).withColumn("char_count", F.length("text"))
