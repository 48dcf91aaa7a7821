"""Column functions for what a run writes: headings, collapsible text, audit lines, file names, alerts, fill ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_of
from .tokens import CONTEXT_LIMIT

CAPTION = "### Descrição da imagem"  # fixed value


def caption_block(description: Column, number: Column) -> Column:
    """A caption under its heading, numbered where several share a page; one that has its heading stays as it is."""
    body = strip(text_of(description))
    numbered = F.coalesce(number >= 1, F.lit(False))
    heading = F.when(numbered, F.concat(F.lit(CAPTION + " "), number.cast("string"))).otherwise(F.lit(CAPTION))
    has_it = F.when(numbered, (body == heading) | body.startswith(F.concat(heading, F.lit("\n"))) | body.startswith(F.concat(heading, F.lit("\r\n")))).otherwise(body.startswith(CAPTION))
    return F.when(body == "", "").when(has_it, body).otherwise(F.concat_ws("\n", heading, body))


def with_details(markdown: Column, raw: Column) -> Column:
    """Markdown with the recognised text in a collapsible block, unless there is one."""
    body, text = F.regexp_replace(text_of(markdown), r"(?U)\s+\z", ""), strip(text_of(raw))
    block = F.concat(body, F.lit("\n\n<details><summary>Texto OCR completo</summary>\n\n"), text, F.lit("\n\n</details>"))
    return F.when((text == "") | body.contains("<details>"), body).otherwise(block)


def page_start_line(case: Column, page: Column, fls: Column, device: Column, library: Column, kind: Column, subtype: Column) -> Column:
    """The audit line of a page's start."""
    value = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    tail = F.when(text_of(subtype) != "", F.concat(F.lit(" subtype="), subtype)).otherwise("")
    return F.concat(F.concat_ws(" ", F.lit("PAGE_START"), value("processo", case), value("pagina", page), value("fls", F.coalesce(fls.cast("string"), F.lit("-"))), value("device", device), value("library", library), value("tipo", kind)), tail)


def output_name(stem: Column, mode: Column, model: Column) -> Column:
    """Name of a document's Markdown file; the caller adds a time where runs must not overwrite each other."""
    return F.concat(F.concat_ws("_", stem, F.lit("ocr"), F.coalesce(F.nullif(F.lower(strip(mode)), F.lit("")), F.lit("cpu")), F.coalesce(model, F.lit("nenhum"))), F.lit(".md"))


def limit_alert(openai: Column, gemini: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """What is said when a provider's count exceeds the context limit, else null."""
    shown = lambda name, c: F.when(c > limit, F.concat(F.lit(f"{name}: "), F.format_number(c, 0)))
    return F.when((openai > limit) | (gemini > limit), F.concat(F.lit(f"ALERTA: a contagem real do markdown ultrapassa {limit:,} tokens ("), F.concat_ws("; ", shown("OpenAI", openai), shown("Gemini", gemini)), F.lit(").")))


def fill_trct(hits: Column, rows: Column, homologation: Column, fields: Column) -> Column:
    """Fill ratio of a termination form: required fields of six, raised by table rows and by a homologation."""
    by_rows = F.when(rows > 0, F.least(F.lit(1.0), F.lit(0.4) + rows * 0.05)).otherwise(0.0)
    return F.greatest(hits / 6.0, by_rows, F.when(homologation & (fields > 0), 0.55).otherwise(0.0))


def fill_register(hits: Column, rows: Column, pairs: Column) -> Column:
    """Fill ratio of an employee register."""
    return F.greatest(hits / 3.0, F.when(rows >= 3, 0.7).otherwise(0.0), F.when(pairs >= 8, 0.6).otherwise(0.0))


def fill_slip(events: Column, net: Column, company_id: Column, name: Column, titles: Column, amounts: Column) -> Column:
    """Fill ratio of a pay slip, with caps for two slips on a page and for few amounts."""
    raised = F.greatest(F.when(events >= 3, 0.7).otherwise(0.0), F.when(net & company_id, 0.8).otherwise(0.0), F.when(name & company_id, 0.5).otherwise(0.0), F.when(events >= 1, 0.45).otherwise(0.0))
    capped = F.when((titles >= 2) & (amounts < 8), F.least(raised, F.lit(0.30))).otherwise(raised)
    return F.when(amounts < 3, F.least(capped, F.lit(0.35))).otherwise(capped)


def fill_fund(name: Column, number: Column, rows: Column, balance: Column) -> Column:
    """Fill ratio of a fund statement."""
    steps = ((name | number, 0.4), (rows >= 2, 0.8), (balance & name, 0.6), (rows >= 5, 0.9))
    return F.greatest(*[F.when(c, v).otherwise(0.0) for c, v in steps])


def fill_generic(pairs: Column, labels: int) -> Column:
    return F.least(F.lit(1.0), pairs / float(max(3, min(6, labels))))
