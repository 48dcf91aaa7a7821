"""Second ways: texts page by page where a whole file's pages don't add up, and single results where a batch's don't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow
from ..functions.text import strip, text_of

RESULT = "struct<text:string,tables:array<string>,language:string>"


def page_texts(files: DataFrame, read_page: Callable[[str, int], str | None], path: str = "path") -> DataFrame:
    """(path, page_no, text, by_page) of files (path, text, n_pages): the pages that a text's form feeds give if they are as many
    as expected, else each page as ``read_page(path, page_no)`` reads it. Files whose text is accepted never reach that function; a
    page that it can't read (null) is empty, and a file without pages has no rows."""
    class PageByPage:
        def eval(self, path: str, n: int) -> Iterator[tuple[int, str]]:
            for k in range(1, (n or 0) + 1):
                yield k, read_page(path, k) or ""

    each = F.udtf(PageByPage, returnType="page_no int, text string")
    judged = files.select(F.col(path).alias("path"), "n_pages", flow.accepted_pages(text_of(F.col("text")), F.col("n_pages")).alias("_p"))
    whole = judged.where("_p IS NOT NULL").select("path", F.posexplode("_p").alias("_k", "text")).select("path", (F.col("_k") + 1).alias("page_no"), "text", F.lit(False).alias("by_page"))
    refused = judged.where("_p IS NULL").select("path", "n_pages")
    read = refused.lateralJoin(each(F.col("path").outer(), F.col("n_pages").outer())).select("path", "page_no", strip(F.col("text")).alias("text"), F.lit(True).alias("by_page"))
    return whole.unionByName(read)


def result_columns(result: Column) -> dict[str, Column]:
    """What a page's result (text, tables, language) says: stripped text, whether there are tables, language, tables with content."""
    tables = F.coalesce(result["tables"], F.array().cast("array<string>"))
    return {"text": strip(text_of(result["text"])), "has_tables": F.size(tables) > 0, "language": result["language"], "tables": F.filter(tables, lambda t: F.coalesce(t, F.lit("")) != "")}


def batch_results(pages: DataFrame, batches: DataFrame, singles: DataFrame, batch: list[str]) -> DataFrame:
    """Results of pages (``batch`` columns, page_no): by position from their batch (``batch`` columns, results array) if it has one
    result a page and two pages or more, else each page's own (``batch`` columns, page_no, result); ``from_batch`` tells which.

    A batch's options are those of its pages together, so its results are taken or refused as a whole. A page without any
    result has an empty text.
    """
    whole = Window.partitionBy(*batch)
    placed = pages.select(*batch, "page_no").withColumn("_k", F.row_number().over(whole.orderBy("page_no"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    told = placed.join(batches.select(*batch, F.col("results").cast(f"array<{RESULT}>").alias("_r")), batch, "left")
    good = F.coalesce((F.size("_r") == F.col("_n")) & (F.col("_n") >= 2), F.lit(False))
    own = singles.select(*batch, "page_no", F.col("result").cast(RESULT).alias("_own"))
    each = told.withColumn("from_batch", good).join(own, [*batch, "page_no"], "left")
    result = F.when(F.col("from_batch"), F.get("_r", F.col("_k") - 1)).otherwise(F.col("_own"))
    one = each.select(*batch, "page_no", "from_batch", result.alias("_one"))
    return one.select(*batch, "page_no", "from_batch", *[c.alias(n) for n, c in result_columns(F.col("_one")).items()])
