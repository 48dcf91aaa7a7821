"""Figures and boxes of recognised pages: listings, reading order, merged word lists, captions in a body, near-equal texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stamps import squeeze
from ..functions.text import lines, strip, text_of


def image_listing(df: DataFrame, key: str, listing: str) -> DataFrame:
    """Rows of a column-aligned image listing; headings, rules, short or odd rows and masks are left out."""
    each = df.select(key, F.explode(lines(F.col(listing))).alias("line")).withColumn("line", strip(F.col("line")))
    p = each.where((F.col("line") != "") & ~F.col("line").startswith("page") & ~F.col("line").startswith("-")).select(key, F.split("line", r"(?U)\s+", -1).alias("p")).where(F.size("p") >= 10)
    number = lambda k: F.get("p", F.lit(k)).try_cast("int")
    out = p.select(key, number(0).alias("page_no"), number(1).alias("num"), F.lower(F.get("p", F.lit(2))).alias("img_type"), number(3).alias("width"), number(4).alias("height"), F.lower(F.get("p", F.lit(8))).alias("encoding"), F.coalesce(F.get("p", F.lit(10)), F.lit("")).alias("object_id"))
    return out.dropna(subset=["page_no", "num", "width", "height"]).where(~F.col("img_type").isin("mask", "smask"))


def reading_order(boxes: DataFrame, key: str) -> DataFrame:
    """(key, text) of snippets (text, x, y, height): rows are opened by their first snippet and hold what lies within the
    tolerance of it, so each page is one fold over its sorted snippets."""
    kind = "struct<y:double,rows:array<array<struct<x:double,t:string>>>>"
    filled = boxes.withColumn("t", strip(F.col("text"))).where("t <> ''")
    grouped = filled.groupBy(key).agg(F.percentile(F.greatest(F.col("height").cast("double"), F.lit(1.0)), F.lit(0.5)).alias("_m"), F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "t"))).alias("_b"))
    tolerance = F.greatest(F.lit(10.0), F.col("_m") * 0.5)

    def step(acc: Column, b: Column) -> Column:
        one = F.struct(b["x"].alias("x"), b["t"].alias("t"))
        last = F.try_element_at(acc["rows"], F.lit(-1))
        grown = F.array_append(F.slice(acc["rows"], F.lit(1), F.greatest(F.size(acc["rows"]) - 1, F.lit(0))), F.array_append(last, one))
        near = F.coalesce(F.abs(b["y"] - acc["y"]) <= tolerance, F.lit(False))
        return F.when(near, F.struct(acc["y"].alias("y"), grown.alias("rows"))).otherwise(F.struct(b["y"].alias("y"), F.array_append(acc["rows"], F.array(one)).alias("rows")))

    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<array<struct<x:double,t:string>>>").alias("rows")).cast(kind)
    rows = F.aggregate("_b", start, step, lambda a: a["rows"])
    row_text = lambda r: F.array_join(F.transform(F.array_sort(r), lambda w: w["t"]), " ")
    return grouped.select(key, F.array_join(F.transform(rows, row_text), "\n").alias("text"))


def column_bands(words: DataFrame, key: str, most: int = 6, least_share: float = 0.08) -> DataFrame:
    """(key, band, start, end): a page's width cut at the middle of its widest gaps between word centres."""
    page = Window.partitionBy(key)
    mid = words.select(key, (F.col("x") + F.col("w") / 2).alias("c"), F.max(F.col("x") + F.col("w")).over(page).alias("width"))
    gap = mid.withColumn("a", F.lag("c").over(page.orderBy("c"))).withColumn("gap", F.col("c") - F.col("a")).where(F.col("gap") >= F.col("width") * least_share)
    top = gap.withColumn("k", F.row_number().over(page.orderBy(F.col("gap").desc(), F.col("a").desc()))).where(F.col("k") < most)
    cuts = top.groupBy(key).agg(F.sort_array(F.collect_list((F.col("a") + F.col("c")) / 2)).alias("cuts"))
    bounds = mid.groupBy(key).agg(F.max("width").cast("double").alias("width")).join(cuts, key, "left")
    edges = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array("width"))
    bands = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).cast("long").alias("start"), F.get(edges, i + 1).cast("long").alias("end")))
    return bounds.select(key, F.posexplode(bands).alias("band", "b")).select(key, "band", "b.start", "b.end")


def merge_words(words: DataFrame, key: str, threshold: float = 0.35) -> DataFrame:
    """Word lists of two passes (``source`` 0 and 1) as one. A word of the second pass that overlaps no kept one is added;
    else it replaces the first overlapped one of lower confidence. What is kept changes what follows, so pages are folded one by one."""
    names = ("word", "x", "y", "w", "h", "conf")

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["source"], r["word_no"]))
        kept = [r for r in rows if r["source"] == 0]
        grid = _Grid(rows)
        for k, r in enumerate(kept):
            grid.add(k, r)
        for r in rows[len(kept) :]:
            close = [k for k in grid.near(r) if _iou(r, kept[k]) >= threshold]
            if not close:
                grid.add(len(kept), r)
                kept.append(r)
            elif weaker := [k for k in close if kept[k]["conf"] < r["conf"]]:
                grid.move(weaker[0], kept[weaker[0]], r)
                kept[weaker[0]] = r
        kept.sort(key=lambda r: (r["y"], r["x"]))
        return pa.table({n: pa.array([r[n] for r in kept], table.schema.field(n).type) for n in (key, *names)})

    fields = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    return words.groupBy(key).applyInArrow(merge, ", ".join(f"{n} {fields[n]}" for n in (key, *names)))


class _Grid:
    """Boxes by the cells of a page that they lie on, so that a box meets its neighbours only. A box on very many cells is met by all."""

    MOST = 64

    def __init__(self, boxes: list[dict]):
        middle = lambda n: max(sorted(b[n] for b in boxes)[len(boxes) // 2], 1e-9) if boxes else 1.0
        self.w, self.h, self.cells, self.large = 2 * middle("w"), 2 * middle("h"), defaultdict(set), set()

    def _of(self, b: dict) -> list[tuple[int, int]] | None:
        x0, x1 = int(b["x"] // self.w), int((b["x"] + b["w"]) // self.w)
        y0, y1 = int(b["y"] // self.h), int((b["y"] + b["h"]) // self.h)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > self.MOST:
            return None
        return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def _sets(self, b: dict) -> list[set[int]]:
        cells = self._of(b)
        return [self.large] if cells is None else [self.cells[c] for c in cells]

    def add(self, k: int, b: dict) -> None:
        for held in self._sets(b):
            held.add(k)

    def move(self, k: int, old: dict, new: dict) -> None:
        for held in self._sets(old):
            held.discard(k)
        self.add(k, new)

    def near(self, b: dict) -> list[int]:
        """Numbers of the boxes that may overlap ``b``, in order."""
        cells = self._of(b)
        found = self.cells.values() if cells is None else (self.cells[c] for c in cells if c in self.cells)
        return sorted(self.large.union(*found))


def _iou(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = max(0, w) * max(0, h)
    every = a["w"] * a["h"] + b["w"] * b["h"] - both
    return both / every if every else 0.0


def merge_figures(bodies: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, body): captions (key, y, x, caption) put between the lines of a body (key, body, height), before the first line
    whose place, spread evenly over the page, is not above the figure."""
    line = bodies.select(key, "height", F.size(lines(F.col("body"))).alias("n"), F.posexplode(lines(F.col("body"))).alias("i", "t"))
    at = F.col("height") * (0.08 + 0.84 * ((F.col("i") + 0.5) / F.greatest(F.col("n"), F.lit(1))))
    mine = figures.where(strip(F.col("caption")) != "").select(key, "y", "x", F.col("caption").alias("t"))
    rows = line.select(key, at.alias("at"), F.lit(1).alias("is_line"), F.col("i").cast("double").alias("x"), "t").unionByName(mine.select(key, F.col("y").cast("double").alias("at"), F.lit(0).alias("is_line"), F.col("x").cast("double").alias("x"), "t"))
    # a new part starts at each figure and at the line after one
    order = Window.partitionBy(key).orderBy("at", "is_line", "x")
    turn = ((F.col("is_line") == 0) | (F.lag("is_line").over(order) == 0)).cast("int")
    part = rows.withColumn("part", F.sum(F.coalesce(turn, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "is_line", "x", "t"))), lambda r: r["t"]), "\n")
    parts = part.groupBy(key, "part").agg(F.regexp_replace(text, r"(?U)\s+\z", "").alias("t")).where(strip(F.col("t")) != "")
    return parts.groupBy(key).agg(squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda r: r["t"]), "\n\n")).alias("body"))


def _ratios(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by matching blocks, as the standard library counts it."""
    return F.pandas_udf(_ratios, "double")(a, b)


def duplicate_text(df: DataFrame, ocr: str, native: str) -> DataFrame:
    """Adds ``duplicate``: whether recognised text says what the text layer says. The ratio runs only on rows that the cheap tests leave open."""
    norm = lambda c: strip(F.regexp_replace(F.lower(text_of(F.col(c))), r"(?U)\s+", " "))
    a, b = F.col("_a"), F.col("_b")
    known = df.withColumn("_a", norm(ocr)).withColumn("_b", norm(native)).withColumn("_d", F.when((F.length(a) < 24) | (b == ""), False).when(b.contains(a), True))
    words = F.filter(F.split(a, " "), lambda w: F.length(w) > 2)
    # only words that both have are looked up, and the page is split once
    held = F.get(F.transform(F.array(F.array_intersect(words, F.split(b, " "))), lambda both: F.size(F.filter(words, lambda w: F.array_contains(both, w)))), F.lit(0))
    share = F.coalesce(F.try_divide(held, F.size(words)), F.lit(0.0))
    settled = known.where("_d IS NOT NULL").withColumn("duplicate", F.col("_d"))
    open_ = known.where("_d IS NULL").withColumn("_ratio", sequence_ratio(F.col("_a"), F.col("_b"))).withColumn("duplicate", (F.col("_ratio") >= 0.72) | (share >= 0.82)).drop("_ratio")
    return settled.unionByName(open_).drop("_a", "_b", "_d")


def message_text(c: Column) -> Column:
    """Text of a chat response in any of its shapes: choices, top-level message, or plain text; listed parts one a line."""
    content = F.coalesce(F.get_json_object(c, "$.choices[0].message.content"), F.get_json_object(c, "$.message.content"))
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    said = F.filter(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "output_text")), lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != "")
    return F.coalesce(F.when(content.startswith("["), F.array_join(said, "\n")).otherwise(content), F.get_json_object(c, "$.text"), F.get_json_object(c, "$.output"), F.lit(""))


def without_control_tokens(c: Column) -> Column:
    """Model output without class, place and box marks."""
    # fixed values: the marks
    for p in (r"</?class_[A-Za-z0-9_]+>", r"</?predict_[A-Za-z0-9_]+>", r"<x_\d+>", r"<y_\d+>", r"</?bbox>", r"\[(\d+(?:[.,]\d+)?),\s*(\d+(?:[.,]\d+)?),\s*(\d+(?:[.,]\d+)?),\s*(\d+(?:[.,]\d+)?)\]"):
        c = F.regexp_replace(c, p, "")
    return squeeze(c)
