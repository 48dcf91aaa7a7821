"""One run: pages, an index, images, figures and what engines said go in, documents as Markdown come out.

``documents`` composes the classification, the branches for native, hybrid and image pages, the letterheads and signatures, and
the assembly. ``run_arriving`` does it for files as they arrive, one micro-batch after the other. Nothing is dropped on the
way: a page with an error keeps its text layer and its reason, a page without an index row, images or engine outputs is judged by
its text, and a queued file without pages counts as failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as rules
from ..functions import stamps, tokens
from ..functions.text import text_of
from ..sources.sinks import through_files
from . import driver
from . import pages as page_ops

PAGE = ["pdf_id", "page_no"]
A4_HEIGHT = 842.0
#: What engines may have said of a page; a column that ``engine`` lacks is null.
ENGINE = {
    "ocr_text": "string", "tables": "array<string>", "ocr_error": "string", "retry_text": "string", "retry_tables": "array<string>", "retry_error": "string", "second_text": "string", "second_tables": "array<string>",
    "filled": "struct<ok:boolean,markdown:string,source:string,fill_ratio:double,n_table_rows:int>", "caption": "string", "error": "string",
}
FIGURE = {"num": "long", "size": "long", "logo": "boolean", "banner": "boolean", "covered": "boolean", "ocr_text": "string", "tables": "array<string>", "caption": "string", "y": "double", "x": "double"}


def _with(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def classified(pages: DataFrame, index: DataFrame, images: DataFrame, least: int = 3) -> DataFrame:
    """Pages (pdf_id, page_no, raw_text) with their stamp, index row, class and subtype, and the text layer without stamps and
    letterheads. ``index`` has (pdf_id, doc_id, tipo, titulo), ``images`` the sizes and places of ``functions.pages.Image``."""
    raw, text = F.col("raw_text"), F.col("residual_text")
    base = pages.select(*PAGE, stamps.residue(raw).alias("residual_text"), stamps.stamp(raw).alias("stamp"), stamps.signature_lines(raw).alias("signature_lines")).withColumn("signature_ids", F.col("stamp.signature_ids"))
    acts = page_ops.index_lookup(base.select(*PAGE, "signature_ids"), index).select(*PAGE, "tipo", "titulo")
    im = rules.Image()
    seen = images.groupBy(*PAGE).agg(F.count_if(im.content).alias("figures"), F.count_if(im.id_strip).alias("strips"), F.count_if(im.content & (im.h >= 900) & (im.aspect >= 1.6)).alias("tall"), F.count_if(im.content & im.full_scan).alias("scans"))
    out = base.join(acts, PAGE, "left").join(seen, PAGE, "left").fillna(0, ["figures", "strips", "tall", "scans"])
    out = out.withColumn("forced", F.coalesce(rules.forced_form(F.col("tipo"), F.col("titulo")), F.lit(False))).withColumn("doc_kind", rules.kind_of_index(F.col("tipo"), F.col("titulo")))
    out = out.withColumn("_overlay", rules.overlay_only(text)).withColumn("_usable", F.when(F.col("_overlay"), False).otherwise(rules.readable(text)))
    out = out.withColumn("page_class", rules.page_class(F.col("forced"), F.col("_overlay"), F.col("_usable"), F.col("figures")))
    out = out.withColumn("subtype", rules.subtype(F.col("page_class"), F.col("tall"), F.col("strips"), F.col("scans"), F.col("figures"))).drop("_overlay", "_usable", "tall", "scans", "strips")
    out = through_files(out)  # the letterheads read it three times
    bare = page_ops.strip_letterheads(out.withColumn("_keep", F.coalesce(rules.preserved(F.col("tipo")), F.lit(False))), least, exempt=F.col("_keep"))
    # and three branches, figures and case numbers read what the letterheads leave
    return through_files(out.drop("residual_text").join(bare, PAGE))


def settled_pages(pages: DataFrame, figures: DataFrame, engine: DataFrame) -> DataFrame:
    """Pages of ``classified`` after their branch: text, kind, source, has_tables, images_described, ocr_failed, reason and counts."""
    key = F.struct(*PAGE).alias("_k")
    said = _with(engine, PAGE, ENGINE)
    known = pages.withColumn("fls", F.col("stamp.fls").cast("long")).join(said, PAGE, "left").select("*", key)
    shown = _with(figures, PAGE, FIGURE).select("*", key)
    of = lambda c: known.where(F.col("page_class") == c)
    none = {"has_tables": F.lit(False), "images_described": F.lit(0).cast("long"), "ocr_failed": F.lit(False), "reason": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "kind": F.col("doc_kind")}
    native = driver.native_pages(of("native")).withColumns({k: v for k, v in none.items() if k != "kind"})
    hybrid = of("hybrid")
    joined = driver.hybrid_pages(hybrid.select("_k", F.col("residual_text").alias("body"), F.lit(A4_HEIGHT).alias("height")), shown.join(hybrid.select("_k"), "_k", "left_semi"), "_k")
    hybrid = hybrid.withColumns({k: v for k, v in none.items() if k not in ("has_tables", "images_described")}).join(joined, "_k")
    image = of("image_page").withColumn("tables", F.col("tables"))
    several = driver.page_figures(shown.where((F.col("size") >= driver.FIGURE_BYTES) & ~F.coalesce("logo", F.lit(False)) & ~F.coalesce("banner", F.lit(False))).join(image.select("_k"), "_k", "left_semi"), "_k")
    image = driver.image_pages(image.join(several.select("_k", F.struct("text", "images_described", "has_tables").alias("figures_said")), "_k", "left").drop("figures").withColumnRenamed("figures_said", "figures"))
    names = [*PAGE, "page_class", "subtype", "fls", "residual_text", "signature_ids", "signature_lines", "text", "kind", "source", "has_tables", "images_described", "ocr_failed", "reason", "error"]
    every = native.select(names).unionByName(hybrid.select(names)).unionByName(image.select(names))
    return driver.settled(every)


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def assembled(pages: DataFrame, cases: DataFrame, mode: str = "CPU", engine: str = "tesseract") -> DataFrame:
    """(pdf_id, markdown and counts) of settled pages; ``cases`` has (pdf_id, case_number, n_index, seconds), each null where unknown."""
    signed = page_ops.keep_signature(pages)
    body = stamps.clean_body(F.col("text"), F.col("keep_signature"), F.col("signature_lines"))
    section = page_ops.page_section(F.col("page_no"), F.col("fls"), body, F.col("ocr_failed"), F.col("reason"))
    texts = signed.select("pdf_id", "page_no", section.alias("_s")).groupBy("pdf_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "_s"))).alias("_p"))
    facts = page_ops.document_statistics(pages.withColumn("processing_time", F.lit(0.0))).drop("avg_time_per_page")
    known = facts.join(texts, "pdf_id").join(cases, "pdf_id", "left")
    c, bullet = F.col, lambda label, value, plain="": F.concat(F.lit(f"- **{label}**{plain}: "), value.cast("string"))
    some = lambda value, line: F.when(F.coalesce(value, F.lit(0)) > 0, line)
    seconds = F.concat(F.format_string("%.2f", F.coalesce(c("seconds").cast("double"), F.lit(0.0))), F.lit("s"))
    # fixed values: the wording of the output
    head = F.concat_ws("\n\n", F.concat(F.lit("# Documento: "), c("pdf_id")), F.concat(F.lit("**Número do processo**: `"), c("case_number"), F.lit("`")), F.lit("## Metadados do Documento"))
    about = F.concat_ws("\n", bullet("Total de páginas", c("total_pages")), bullet("Modo de processamento", F.lit(mode)), bullet("Engine OCR", F.lit(engine)), bullet("Tempo total de processamento", seconds), some(c("n_index"), bullet("Documentos no SUMÁRIO PJe", c("n_index"))))
    analysis = F.concat_ws(
        "\n", F.lit("### Análise de Páginas"), bullet("Páginas nativas", c("native_pages"), " (texto digital)"), bullet("Páginas híbridas", c("hybrid_pages")), bullet("Páginas imagem/OCR", c("image_pages")),
        some(c("ocr_failed_pages"), bullet("Falhas de OCR", c("ocr_failed_pages"))), some(c("pages_with_tables"), bullet("Páginas com tabelas", c("pages_with_tables"))),
        bullet("Total de palavras extraídas", _grouped(c("total_words"))), bullet("Total de caracteres", _grouped(c("total_characters"))),
    )
    sections = F.array_join(F.transform("_p", lambda x: F.concat(x["_s"], F.lit("\n\n---"))), "\n\n")
    contents = F.concat_ws(
        "\n", F.lit("### Conteúdo"), bullet("Total de páginas processadas", c("total_pages")), bullet("Páginas nativas", c("native_pages")), bullet("Páginas híbridas", c("hybrid_pages")), bullet("Páginas com OCR", c("image_pages")),
        bullet("Páginas com tabelas", c("pages_with_tables")), bullet("Total de palavras", _grouped(c("total_words"))), bullet("Total de caracteres", _grouped(c("total_characters"))),
    )
    whole = known.withColumn("_m", F.concat_ws("\n\n", head, about, analysis, sections, F.lit("## Estatísticas Gerais do Processamento"), contents))
    counted = whole.withColumn("_tokens", tokens.heuristics(c("_m"))).withColumns({"openai_tokens": c("_tokens.openai"), "gemini_tokens": c("_tokens.gemini")})
    # token counts follow the last line of the statistics, and are of the text without them
    markdown = F.concat_ws("\n", c("_m"), bullet("Tokens OpenAI", _grouped(c("openai_tokens"))), bullet("Tokens Gemini", _grouped(c("gemini_tokens"))))
    return counted.select("pdf_id", markdown.alias("markdown"), "total_pages", "native_pages", "hybrid_pages", "image_pages", "pages_with_tables", "ocr_failed_pages", "total_words", "total_characters", "openai_tokens", "gemini_tokens")


def documents(pages: DataFrame, index: DataFrame, images: DataFrame, figures: DataFrame, engine: DataFrame, mode: str = "CPU") -> DataFrame:
    """One row a document, from the pages' texts to its Markdown."""
    known = classified(pages, index, images)
    cases = known.groupBy("pdf_id").agg(F.min_by("stamp.process_number", F.when(F.col("stamp.process_number").isNotNull(), F.col("page_no"))).alias("case_number"))
    cases = cases.join(index.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("n_index")), "pdf_id", "left").withColumn("seconds", F.lit(None).cast("double"))
    return assembled(through_files(settled_pages(known, figures, engine)), cases, mode)


def run_arriving(pages: DataFrame, run: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Runs ``run`` on each micro-batch of a stream of pages that has arrived. A file holds whole documents, so a micro-batch does.

    Each batch has a folder of its own under ``target``, named by its id and replaced as a whole: a batch that is done again after a
    failure leaves its rows once.
    """
    def batch(df: DataFrame, number: int) -> None:
        run(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def done(spark: SparkSession, target: str) -> DataFrame:
    """Documents of all batches, with ``batch``."""
    return spark.read.option("basePath", target).parquet(target)


def batch_summary(queued: DataFrame, finished: DataFrame) -> DataFrame:
    """(total, ok, failed, failed_pages) of a queue (pdf_id): a file without a document, or whose pages all failed, has failed."""
    found = finished.select("pdf_id", F.col("ocr_failed_pages").alias("_f"), (F.col("ocr_failed_pages") < F.col("total_pages")).alias("_ok"))
    each = queued.select("pdf_id").distinct().join(found, "pdf_id", "left")
    return each.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("_ok", F.lit(False))).alias("ok"), F.count_if(~F.coalesce("_ok", F.lit(False))).alias("failed"), F.coalesce(F.sum("_f"), F.lit(0)).cast("long").alias("failed_pages"))
