"""Page layouts from XML files: pages with the rectangles of their images and texts, read as a data source.

``spark.read.format("layout").load(folder)`` gives one row a page: ``pdf`` (the file's name without its ending), ``number``,
``width``, ``height``, ``images`` (array<struct<x,y,width,height>>) and ``texts`` (the same with ``text``), in the file's order.

The files come from converters that write broken XML, so they are read piece by piece instead of as a tree: a piece goes
from one page's opening tag to the next one's. Defined results: an attribute that is missing or no number counts as 0, a page's
width and height as those of A4; pages whose number is not above 0 are skipped; of pages with one number in a file the last
counts; texts that are empty without tags and gaps are left out; bytes that are no UTF-8 become U+FFFD; a file without
pages gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .file_tree import MANIFEST, parts_of, place_of

# fixed values: size of a page that tells none, and entities in the order in which they are replaced
A4 = (595.0, 842.0)
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "), ("&nbsp;", " "))
_PAGE, _ATTRIBUTE, _TAG = re.compile(r"<page\b([^>]*)>", re.I), re.compile(r'([\w:-]+)\s*=\s*"([^"]*)"'), re.compile("<[^>]+>")
_IMAGE, _TEXT = re.compile(r"<image\b([^>]*)>", re.I), re.compile(r"<text\b([^>]*)>(.*?)</text>", re.I | re.S)
SCHEMA = "pdf string, number int, width double, height double, images array<struct<x:double,y:double,width:double,height:double>>, texts array<struct<x:double,y:double,width:double,height:double,text:string>>"
_RECT = [(n, pa.float64()) for n in ("x", "y", "width", "height")]
_ARROW = pa.schema([("pdf", pa.string()), ("number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("images", pa.list_(pa.struct(_RECT))), ("texts", pa.list_(pa.struct([*_RECT, ("text", pa.string())])))])


def _number(attributes: dict[str, str], names: tuple[str, ...], default: float = 0.0) -> float:
    for n in names:
        try:
            return float(attributes[n])
        except (KeyError, ValueError):
            continue
    return default


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v for k, v in _ATTRIBUTE.findall(tag)}


def _rect(tag: str) -> dict:
    a = _attributes(tag)
    return {"x": _number(a, ("left", "x")), "y": _number(a, ("top", "y")), "width": _number(a, ("width",)), "height": _number(a, ("height",))}


def plain(xml: str) -> str:
    """A text's content without tags, its entities resolved, its gaps single spaces."""
    out = _TAG.sub("", xml)
    for entity, char in ENTITIES:
        out = out.replace(entity, char)
    return re.sub(r"\s+", " ", out).strip()


def pages_of(xml: str) -> list[dict]:
    """The pages of one file, by number."""
    opened, out = list(_PAGE.finditer(xml)), {}
    for k, tag in enumerate(opened):
        a = _attributes(tag[1])
        number = _number(a, ("number",))
        if not 1 <= number < 1 << 31:
            continue
        piece = xml[tag.end() : opened[k + 1].start() if k + 1 < len(opened) else len(xml)]
        texts = [{**_rect(t[1]), "text": said} for t in _TEXT.finditer(piece) if (said := plain(t[2]))]
        images = [_rect(t) for t in _IMAGE.findall(piece)]
        out[int(number)] = {"number": int(number), "width": _number(a, ("width",), A4[0]), "height": _number(a, ("height",), A4[1]), "images": images, "texts": texts}
    return [out[n] for n in sorted(out)]


@dataclass
class Files(InputPartition):
    paths: list[str]


class LayoutReader(DataSourceReader):
    """Deals the files into partitions of about ``bytesPerPartition`` (64 MB unless given)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("bytespartition", options.get("bytesPerPartition", 64 << 20)))

    def partitions(self) -> list[Files]:
        files, root = place_of(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            found = [files.get_file_info(root)]
        else:
            # a folder that ``write_files`` wrote is read by its manifests
            told = any(x.base_name.startswith(MANIFEST) for x in files.get_file_info(fs.FileSelector(root)))
            roots = [place_of(p)[1] for p in parts_of(self.path)] if told else [root]
            found = [x for r in roots for x in files.get_file_info(fs.FileSelector(r, recursive=True)) if x.type == fs.FileType.File and x.base_name.lower().endswith(".xml")]
        dealt, size = [], 0
        for x in sorted(found, key=lambda x: x.path):
            if not dealt or size + x.size > self.most:
                dealt.append(Files([]))
                size = 0
            dealt[-1].paths.append(x.path)
            size += x.size
        return dealt

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = place_of(self.path)
        for path in partition.paths if partition else ():
            with files.open_input_stream(path) as f:
                xml = f.read().decode("utf-8", "replace")
            pdf = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            found = pages_of(xml)
            for lo in range(0, len(found), 64):
                yield pa.RecordBatch.from_pylist([{"pdf": pdf, **p} for p in found[lo : lo + 64]], schema=_ARROW)


class LayoutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayoutReader:
        return LayoutReader(self.options)


def read_layouts(spark, path: str) -> DataFrame:
    spark.dataSource.register(LayoutSource)
    return spark.read.format("layout").load(path)


def with_layout(pages: DataFrame, layouts: DataFrame, pdf: str = "pdf_id", number: str = "page_no") -> DataFrame:
    """``pages`` with ``layout`` (struct<width,height,images,texts>) of their file and number, null where there is none."""
    found = layouts.select(F.col("pdf").alias(pdf), F.col("number").alias(number), F.struct("width", "height", "images", "texts").alias("layout"))
    return pages.join(found, [pdf, number], "left")


def covered(rects: DataFrame, rect: str = "rect", layout: str = "layout", least: int = 40) -> DataFrame:
    """``rects`` (a rectangle of a page and the page's layout) with ``covered``: whether the texts whose centre lies in the rectangle
    have at least ``least`` characters together."""
    r = F.col(rect)
    inside = lambda t: (t["x"] + t["width"] / 2).between(r["x"], r["x"] + r["width"]) & (t["y"] + t["height"] / 2).between(r["y"], r["y"] + r["height"])
    sized = (r["width"] > 0) & (r["height"] > 0)
    length = F.aggregate(F.filter(F.col(layout)["texts"], inside), F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]))
    return rects.withColumn("covered", F.coalesce(sized & (length >= least), F.lit(False)))
