"""Progress of a run: its classification summary and its pages as events, and counts taken while the pages pass by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

CLASSES = ("native", "hybrid", "image_page")


def _is(name: str) -> Column:
    return F.col("page_class") == name


def events(pages: DataFrame, pdf: str = "pdf_id", page: str = "page_no") -> DataFrame:
    """(pdf, place, kind, page, total, native_pages, hybrid_pages, image_pages, force_ocr_skipped) from pages (page_class, forced).

    A document's first event (place 0, ``classification``) has its counts and page 0; then each page has one (``page``) in the
    order of pages, with null counts. ``force_ocr_skipped`` are the pages that should have been read as images and have a usable
    text. The pages pass one shuffle and one sort, whatever their number.
    """
    whole = Window.partitionBy(pdf)
    counts = {f"{c.removesuffix('_page')}_pages": F.count_if(_is(c)).over(whole) for c in CLASSES}
    skipped = F.count_if(F.coalesce("forced", F.lit(False)) & ~_is("image_page")).over(whole)
    each = pages.withColumns({"_place": F.row_number().over(whole.orderBy(page)), "_total": F.count(F.lit(1)).over(whole), **counts, "force_ocr_skipped": skipped})
    names = [*counts, "force_ocr_skipped"]
    row = lambda place, kind, at, shown: F.struct(place.alias("place"), F.lit(kind).alias("kind"), at.cast("long").alias("page"), *[(F.col(n) if shown else F.lit(None).cast("long")).alias(n) for n in names])
    own = row(F.col("_place"), "page", F.col(page), False)
    out = F.when(F.col("_place") == 1, F.array(row(F.lit(0), "classification", F.lit(0), True), own)).otherwise(F.array(own))
    return each.select(pdf, F.col("_total").alias("total"), F.explode(out).alias("_e")).select(pdf, "_e.place", "_e.kind", "_e.page", "total", *[f"_e.{n}" for n in names])


def counts() -> list[Column]:
    """Aggregates of a run's pages: total, each class, and failed ones."""
    return [F.count(F.lit(1)).alias("total"), *[F.count_if(_is(c)).alias(c) for c in CLASSES], F.count_if("ocr_failed").alias("failed")]


def observed(pages: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """``pages`` (page_class, ocr_failed), and what ``counts`` saw of them once an action has run: no pass of its own."""
    seen = Observation(name)
    return pages.observe(seen, *counts()), seen


class RunListener(StreamingQueryListener):
    """Keeps each micro-batch's counts of a stream with ``observe(name, *counts())``, as (batch id, counts), newest last; of older
    ones than ``keep`` only their sums stay."""

    def __init__(self, name: str = "run", keep: int = 1000):
        self.name, self.keep, self.batches, self.sums = name, keep, [], {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row["total"]:
            return
        self.batches = [*self.batches, (event.progress.batchId, row.asDict())][-self.keep :]
        for k, v in row.asDict().items():
            self.sums[k] = self.sums.get(k, 0) + v

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
