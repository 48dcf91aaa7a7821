"""Rules that steer a page through the engine: kinds, message classes, batch sizes, and small parsers of tool output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pages import has, kind_of_text
from .text import flagged, strip, text_of

# fixed values: markers of licences, kinds with a template, messages of a full GPU, thresholds in GB
LICENCE = ("habilita", "senatran", "cnh", "driver license")
HOMOLOGATION = ("termo de homologação", "termo de homologacao")
FULL_GPU = r"CUBLAS failure 3\b|CUBLAS_STATUS_ALLOC_FAILED|CUDNN_STATUS_ALLOC_FAILED|cudaErrorMemoryAllocation|CUDA_ERROR_OUT_OF_MEMORY|out of memory|Failed to allocate memory"
BATCH_GB, HIGH_GB = 8.0, 12.0
TYPE_COLUMN = 60


def refined_kind(kind: Column, text: Column) -> Column:
    """The kind, or the text's kind where there is none; an identity card with a licence's words is a licence."""
    return F.when(F.coalesce(kind, F.lit("")) == "", kind_of_text(text)).when((kind == "identidade") & has(F.lower(text_of(text)), *LICENCE), "cnh").otherwise(kind)


def form_kind(text: Column, hint: Column) -> Column:
    """Kind of a form: an act of homologation is a termination form, then the text's kind, then the hint."""
    found = kind_of_text(text)
    return F.when(has(F.lower(text_of(text)), *HOMOLOGATION), "trct").otherwise(F.coalesce(found, hint))


def gpu_full(message: Column) -> Column:
    """Whether an engine's message says that the GPU ran out of memory."""
    return text_of(message).rlike(flagged(FULL_GPU, "i"))


def console_line(line: Column) -> Column:
    """Whether a log line is shown; page rows of the audit are not."""
    return ~text_of(line).startswith("PAGE_")


def batch_size(configured: Column, gpu: Column, gigabytes: Column) -> Column:
    """Pages recognised together: one without a GPU, two at most on a small one."""
    return F.when(~gpu, 1).when(gigabytes < BATCH_GB, F.least(configured, F.lit(2))).otherwise(F.greatest(F.lit(1), configured))


def line_batch(configured: Column, gpu: Column, gigabytes: Column) -> Column:
    """Lines recognised together, by the GPU's memory."""
    return F.when(~gpu | (gigabytes >= HIGH_GB), configured).when(gigabytes < BATCH_GB, F.least(configured, F.lit(4))).otherwise(F.least(configured, F.lit(8)))


def info_field(text: Column, field: str) -> Column:
    """Value of the first line of a tool's report that begins with ``field`` and a colon."""
    pattern = f"(?m)^{field}:(.*)$"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def page_count(text: Column) -> Column:
    return info_field(text, "Pages").try_cast("int")


def accepted_pages(text: Column, expected: Column) -> Column:
    """Pages of a text with form feeds, if they are as many as expected (one blank at the end aside); null asks for the fallback."""
    parts = F.transform(F.split(text, "\f", -1), lambda x: strip(x))
    filled = F.filter(parts, lambda x: x != "")
    spare = (F.size(filled) == expected + 1) & (F.element_at(parts, -1) == "")
    return F.when(text.contains("\f"), F.when(F.size(filled) == expected, filled).when(spare, F.slice(parts, F.lit(1), expected)))


def money_after(text: Column, pattern: str) -> Column:
    """First group of the first match, or ''."""
    return F.regexp_extract(text_of(text), flagged(pattern, "i"), 1)


def line_after(text: Column, pattern: str) -> Column:
    """What follows a label on its line, or ''."""
    return strip(F.regexp_extract(text_of(text), flagged(rf"{pattern}\s*[:|]?\s*(.+)", "i"), 1))


def title_and_type(rest: Column, line: Column) -> Column:
    """struct<title,type> of the part of an index line after its date: cut where the type's column begins, else at the last wide gap."""
    at = F.instr(line, rest) - 1
    cut = TYPE_COLUMN - at
    parts = F.split(strip(rest), r"(?U)\s{2,}", -1)
    gap = F.struct(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(strip(rest)).alias("title"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("type"))
    column = F.struct(strip(F.substr(rest, F.lit(1), cut)).alias("title"), strip(F.substr(rest, cut + 1, F.length(rest))).alias("type"))
    return F.when((at >= 0) & (cut > 0) & (cut < F.length(rest)), column).otherwise(gap)


def first_present(fields: Column, names: list[str]) -> Column:
    """The first of a key's spellings that a map has, or null."""
    return F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.map_contains_key(fields, n)), F.lit(0))


def logo_file(width: Column, height: Column, size: Column) -> Column:
    """Whether an image file looks like an icon or a stamp; of an unreadable one (no width) the size tells."""
    small = ((F.greatest(width, height) <= 120) & (width * height <= 25_000)) | ((width <= 150) & (height <= 150))
    return F.when(width.isNull() | height.isNull(), size < 4000).otherwise(small)
