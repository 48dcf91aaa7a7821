"""Set operators over boxes and words: ordinal and spatial joins, clustering, reading order, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_markup, lines, strip
from .walks import walked


def plain_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words with made-up boxes, so that parsers of scanned pages run on plain text: 20 high a line, 40 wide a word."""
    line = df.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    word = line.where(strip(F.col("line")) != "").select(key, "line_no", F.posexplode(F.split(strip(F.regexp_replace("line", r"(?U)\s+", " ")), " ")).alias("word_no", "word"))
    return word.select(key, "line_no", "word_no", "word", (F.col("word_no") * 40).alias("x"), (F.col("line_no") * 20).alias("y"), F.greatest(F.lit(20), F.length("word") * 8).alias("w"), F.lit(16).alias("h"))


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes over the area of the first."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h / F.greatest(F.lit(1), a["w"] * a["h"])).otherwise(0.0)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return F.coalesce(F.try_divide(both, a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def box(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in "xywh"}


def _held(share: float) -> Column:
    """Whether a cell (cx, cy, cw, ch) holds a word's centre or enough of its area."""
    a, b = box(""), {k: F.col("c" + k) for k in "xywh"}
    mid_x, mid_y = a["x"] + a["w"] / 2, a["y"] + a["h"] / 2
    inside = mid_x.between(b["x"], b["x"] + b["w"]) & mid_y.between(b["y"], b["y"] + b["h"])
    return inside | (overlap_share(a, b) >= share)


def words_in_cells(words: DataFrame, cells: DataFrame, key: str, share: float = 0.45) -> DataFrame:
    """Words (key, word, x, y, w, h) joined to cells (key, cell, cx, cy, cw, ch) that hold their centre or enough of their area."""
    # both sides come from exploded rows, whose estimate is that of the rows before: a broadcast would be chosen for any size
    return words.join(cells.hint("merge"), key).where(_held(share))


def clusters(df: DataFrame, key: str | list[str], at: str, gap: float) -> DataFrame:
    """(key, cluster, n, centre) of positions whose neighbours lie within ``gap``; the centre is rounded down."""
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy(at)
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    each = df.select(*keys, at, F.coalesce(new, F.lit(0)).alias("_new")).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy(*keys, F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.floor(F.avg(at)).cast("long").alias("centre"))


def colspans(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, col, text, colspan) of filled cells, each taking in the empty ones to its right."""
    order = Window.partitionBy(key, "row").orderBy("col")
    anchored = cells.withColumn("_a", F.last(F.when(F.col("text") != "", F.col("col")), ignorenulls=True).over(order))
    spans = anchored.where(F.col("_a").isNotNull()).groupBy(key, "row", F.col("_a").alias("col")).agg(F.max_by("text", F.col("text") != "").alias("text"), F.count("*").alias("colspan"))
    return spans.select(key, "row", "col", "text", "colspan")


def ruled_cells(marks: DataFrame, key: str, gap: float = 8, least_rows: int = 2, least_cols: int = 2) -> DataFrame:
    """(key, row, col, cx, cy, cw, ch) of the grid that ruled lines span. ``marks`` (key, axis, at) are positions of vertical lines
    (axis x) and horizontal ones (axis y); close ones are one line, and a page with too few lines has no grid."""
    # both axes in one pass: marks may come from pixels, and each branch of a plan would work them out again
    axis, side = F.col("axis"), Window.partitionBy(key, "axis")
    dealt = marks.where(axis.isin("x", "y") & F.col(key).isNotNull()).repartition(key)
    line = clusters(dealt, [key, "axis"], "at", gap).withColumn("_next", F.lead("centre").over(side.orderBy("cluster"))).withColumn("_n", F.count(F.lit(1)).over(side))
    each = line.where((F.col("_n") > F.when(axis == "y", least_rows).otherwise(least_cols)) & F.col("_next").isNotNull())
    track = F.struct("cluster", "centre", (F.col("_next") - F.col("centre")).alias("size"))
    page = each.groupBy(key).agg(F.collect_list(F.when(axis == "y", track)).alias("_rows"), F.collect_list(F.when(axis == "x", track)).alias("_cols"))
    grid = page.select(key, F.explode("_rows").alias("_r"), "_cols").select(key, "_r", F.explode("_cols").alias("_c"))
    return grid.select(key, F.col("_r.cluster").alias("row"), F.col("_c.cluster").alias("col"), F.col("_c.centre").alias("cx"), F.col("_r.centre").alias("cy"), F.col("_c.size").alias("cw"), F.col("_r.size").alias("ch"))


def ruled_tables(marks: DataFrame, words: DataFrame, key: str, gap: float = 8, least_rows: int = 2, least_cols: int = 2) -> DataFrame:
    """(key, row, col, text, colspan) of the grids of pages: words (word, x, y, w, h) in the cells that hold them, in (y, x) order."""
    seen = words.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "word", *"xywh").hint("merge")
    # cells are read once: those without a word stay in the same join
    filled = ruled_cells(marks, key, gap, least_rows, least_cols).join(seen, (F.col(key) == F.col("_key")) & _held(0.45), "left")
    held = F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("y", "x", "word"))))
    texts = filled.groupBy(key, "row", "col").agg(strip(F.array_join(F.transform(held, lambda w: w["word"]), " ")).alias("text"))
    return colspans(texts, key)


def paragraphs(blocks: DataFrame, key: str, gap: int = 14) -> DataFrame:
    """(key, paragraph, text) of blocks (y, x, height, text) merged while the next one starts within ``gap`` of the bottom."""
    order = Window.partitionBy(key).orderBy("y", "x", "text")
    before = F.max(F.col("y") + F.col("height")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = blocks.withColumn("_new", F.coalesce((F.col("y") - before > gap).cast("int"), F.lit(0))).withColumn("paragraph", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = each.groupBy(key, F.col("paragraph").cast("long").alias("paragraph")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("_b"))
    return grouped.select(key, "paragraph", F.array_join(F.transform("_b", lambda b: b["text"]), " ").alias("text"))


def _visual(words: list[tuple[float, float, float, str]], tolerance: float) -> list[str]:
    """Lines of words (y, x, h, word), sorted: a word joins the current line while their centres are close; the line's centre
    and height follow the words that joined."""
    out: list[list[tuple[float, str]]] = []
    top = height = 0.0
    for y, x, h, word in words:
        if out and abs(y + h / 2 - (top + height / 2)) <= max(height, h) * tolerance:
            bottom, top = max(top + height, y + h), min(top, y)
            height = bottom - top
            out[-1].append((x, word))
        else:
            top, height = y, h
            out.append([(x, word)])
    return [" ".join(w for _, w in sorted(line)) for line in out]


def visual_lines(words: DataFrame, key: str, tolerance: float = 0.55) -> DataFrame:
    """(key, line_no, text) of words (x, y, h, word) in (y, x) order. Where a line ends depends on what joined it, so each page is
    walked as a whole, in one pass."""
    double = lambda c: F.col(c).cast("double").alias(c)
    walk = lambda page: list(enumerate(_visual(page, tolerance)))
    return walked(words.select(key, double("y"), double("x"), double("h"), "word"), key, ["y", "x", "h", "word"], walk, "line_no int, text string")


def markup_blocks(df: DataFrame, key: str, html: str, tag: str = "p") -> DataFrame:
    """(key, block_no, text) of the elements of one kind, decoded; empty ones dropped."""
    raw = F.regexp_extract_all(F.col(html), F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    each = df.select(key, F.posexplode(raw).alias("block_no", "_raw")).select(key, "block_no", decode_markup(F.col("_raw")).alias("text"))
    return each.where(F.col("text") != "")


def ordinal_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """i-th row of the left to i-th row of the right within each key; the left stays whole."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "_i"], "left").drop("_i")
