"""Queries over files: figures that are written and read back, layouts, and pages joined to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fallbacks, intake
from ..sources import file_tree, layouts, sinks
from ..sources.tables import PAGES, page_images, table
from .catalogue import _D_IMAGES, _judged_images
from .registry import query

_FIGURE_ROWS = """select *, case when num % 5 = 4 then num + 100000 else num end as idx, num * 29 % 211 * 32 as n_bytes, case when num % 3 > 0 then num % 400 end as file_width, case when num % 3 > 0 then num % 300 end as file_height from c"""


def _figure_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each image, of up to 6,720 bytes; every fifth has an index that no image has, and a third can't be opened."""
    n = F.col("num")
    index = F.when(n % 5 == 4, n + 100_000).otherwise(n).cast("string")
    name = F.concat(F.lit("page_"), F.lpad(F.col("page_no").cast("string"), 4, "0"), F.lit("-"), index, F.lit(".bin"))
    content = F.expr("repeat(md5(cast(num as string)), cast(num * 29 % 211 as int))").cast("binary")
    size = lambda k: F.when(n % 3 > 0, n % k)
    return page_images(spark, d).select("page_no", name.alias("file_name"), content.alias("content"), F.octet_length(content).cast("long").alias("n_bytes"), size(400).alias("file_width"), size(300).alias("file_height"))


@query(f"""{_D_IMAGES}, ff as ({_FIGURE_ROWS}), kk as (select ff.*, coalesce(a.num, b.num) as hit, coalesce(a.content, b.content) as shows from ff left join c a on a.page_no = ff.page_no and a.num = ff.idx left join c b on a.num is null and b.page_no = ff.page_no and b.num = ff.idx + 1 where n_bytes >= 2048)
 select 'doc_' || page_no || '_images' as folder, 'page_' || lpad(page_no::varchar, 4, '0') || '-' || idx || '.bin' as file_name, n_bytes, sha256(repeat(md5(num::varchar), cast(num * 29 % 211 as int))) as digest from kk
 where case when hit is not null then coalesce(shows, false) when file_width is null then n_bytes >= 4000 else not ((greatest(file_width, file_height) <= 120 and file_width * file_height <= 25000) or (file_width <= 150 and file_height <= 150)) end""")
def b4_figure_files(spark, d):
    folder = sinks.shared_folder(spark)
    kept = intake.content_files(_figure_files(spark, d), _judged_images(spark, d))
    file_tree.write_files(kept.select(F.concat(F.lit("doc_"), F.col("page_no").cast("string"), F.lit("_images")).alias("folder"), "file_name", "content"), folder)
    return file_tree.read_files(spark, folder, "*.bin").select("folder", "file_name", "n_bytes", F.sha2("content", 256).alias("digest"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _layout_files(spark: SparkSession, d: str) -> str:
    """Writes a layout file for each ``PAGES`` documents and gives the folder: every seventh page tells no size, every tenth comes after one
    without a number, images of every third have no closing mark or a size that is no number. A line of a text is a text."""
    n, i = F.col("doc_id") % PAGES + 1, F.col("doc_id")
    s = lambda c: c.cast("string")
    opened = F.when(n % 7 == 0, F.concat(F.lit('<PAGE number="'), s(n), F.lit('">'))).otherwise(F.concat(F.lit('<page number="'), s(n), F.lit('" position="absolute" top="0" height="'), s(F.lit(800) + i % 90), F.lit('" width="'), s(F.lit(500) + i % 130), F.lit('">')))
    image = F.when(n % 3 == 0, F.concat(F.lit('<image top="'), s(i % 700), F.lit('" left="'), s(i % 500), F.lit('" width="100" height="50" src="a.png"/>'))).when(n % 3 == 1, F.lit('<image left="5" top="7" width="wide" height="9">')).otherwise("")
    texts = F.transform(F.split("text", "\n", -1), lambda t, k: F.concat(F.lit('<text top="'), s(k * 10), F.lit('" left="'), s(i % 90), F.lit('" width="100" height="9" font="0"><b>'), _escaped(t), F.lit("</b></text>")))
    page = F.concat(F.when(n % 10 == 0, '<page number="0"><text>lost</text>').otherwise(""), opened, image, F.array_join(texts, "\n"), F.when(n % 4 == 0, "").otherwise("</page>"))
    # a file's pages are PAGES at most
    files = table(spark, d, "documents").select(F.concat(F.lit("case-"), F.floor(i / PAGES).cast("string")).alias("folder"), F.struct(n.alias("n"), page.alias("p")).alias("s")).groupBy("folder").agg(F.array_sort(F.collect_list("s")).alias("s"))
    folder = sinks.shared_folder(spark)
    xml = F.concat(F.lit('<?xml version="1.0"?><pdf2xml>'), F.array_join(F.transform("s", lambda x: x["p"]), "\n"), F.lit("</pdf2xml>"))
    file_tree.write_files(files.select("folder", F.concat("folder", F.lit(".xml")).alias("file_name"), xml.alias("content")), folder)
    return folder


_ESCAPED = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_READ = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({_ESCAPED}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#160;', ' '), '&nbsp;', ' '), '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+', ' ', 'g'))"
_LAYOUT = f"""with p as (select doc_id, 'case-' || (doc_id // {PAGES}) as pdf, doc_id % {PAGES} + 1 as n, text from documents),
 l as (select doc_id, {_READ} as said, k from (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as k from p)),
 x as (select doc_id, count(*) as n_texts, sum(k * 10) as tops, md5(string_agg(said, chr(10) order by k)) as digest, sum(length(said)) filter (k <= 30) as above from l where said <> '' group by doc_id),
 lay as (select doc_id, pdf, n, case when n % 7 = 0 then 595 else 500 + doc_id % 130 end::double as width, case when n % 7 = 0 then 842 else 800 + doc_id % 90 end::double as height, case when n % 3 < 2 then 1 else 0 end as n_images,
  case n % 3 when 0 then doc_id % 500 + 100 when 1 then 5 else 0 end::double as image_right, coalesce(n_texts, 0) as n_texts, coalesce(tops, 0)::double as tops, coalesce(digest, md5('')) as digest, coalesce(above, 0) as above from p left join x using (doc_id))"""


@query(f"{_LAYOUT} select pdf, n::int as number, width, height, n_images, image_right, n_texts, tops, digest from lay")
def a10_layout_pages(spark, d):
    sums = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, r: a + f(r))
    return layouts.read_layouts(spark, _layout_files(spark, d)).select(
        "pdf", "number", "width", "height", F.size("images").alias("n_images"), sums("images", lambda r: r["x"] + r["width"]).alias("image_right"), F.size("texts").cast("long").alias("n_texts"), sums("texts", lambda r: r["y"]).alias("tops"),
        F.md5(F.array_join(F.transform("texts", lambda r: r["text"]), "\n").cast("binary")).alias("digest"),
    )


@query(f"{_LAYOUT} select doc_id, n_texts, above >= 40 as covered from lay where doc_id % 9 > 0 union all select doc_id, null, false from p where doc_id % 9 = 0")
def d11_page_layouts(spark, d):
    n = F.col("doc_id") % PAGES + 1
    # every ninth page asks a file that lacks it
    asked = table(spark, d, "documents").select("doc_id", F.concat(F.lit("case-"), F.floor(F.col("doc_id") / PAGES).cast("string"), F.when(F.col("doc_id") % 9 == 0, "x").otherwise("")).alias("pdf_id"), n.cast("int").alias("page_no"))
    found = layouts.with_layout(asked, layouts.read_layouts(spark, _layout_files(spark, d)))
    top = found.withColumn("rect", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(400.0).alias("width"), F.lit(305.0).alias("height")))
    return layouts.covered(top).select("doc_id", F.size("layout.texts").cast("long").alias("n_texts"), "covered").withColumn("n_texts", F.when(F.col("n_texts") >= 0, F.col("n_texts")))


@query(f"""with p as (select doc_id, list_transform(string_split(replace(text, chr(10), chr(12)), chr(12)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) as parts, doc_id % 5 + 1 as expected from documents),
 f as (select *, list_filter(parts, lambda x: x <> '') as filled from p), g as (select *, case when len(parts) > 1 then case when len(filled) = expected then filled when len(filled) = expected + 1 and parts[-1] = '' then parts[1:expected] end end as pages from f)
 select 'doc-' || doc_id as path, unnest(range(1, expected + 1))::int as page_no, md5(unnest(coalesce(pages, list_transform(range(1, expected + 1), lambda k: 'doc-' || doc_id || ' page ' || k)))) as text, pages is null as by_page from g""")
def a5_pages_by_page(spark, d):
    i = F.col("doc_id")
    files = table(spark, d, "documents").select(F.concat(F.lit("doc-"), i.cast("string")).alias("path"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"), (i % 5 + 1).cast("int").alias("n_pages"))
    return fallbacks.page_texts(files, lambda path, page: f" {path} page {page}\n").withColumn("text", F.md5("text"))


@query("""with l as (select l_orderkey as o_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem where l_orderkey % 7 > 0 group by all), o as (select *, count(*) over (partition by o_orderkey) as n, row_number() over (partition by o_orderkey order by l_linenumber) as k from l),
 s as (select *, n >= 2 and o_orderkey % 3 > 0 and o_orderkey % 5 > 0 as from_batch from o)
 select o_orderkey, l_linenumber as page_no, from_batch, case when from_batch then 'lote ' || k else l_returnflag end as text, case when from_batch then k % 2 = 0 else false end as has_tables, case when from_batch then 'por' end as language, case when from_batch and k % 4 = 0 then 1 else 0 end as n_tables from s""")
def m4_batch_results(spark, d):
    # a batch an order: every third lacks its last result, every fifth has none
    key, k = F.col("o_orderkey"), F.col("l_linenumber")
    lines = table(spark, d, "lineitem").where("l_orderkey % 7 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    counts = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n")).where(key % 5 > 0)
    result = lambda i: F.struct(F.concat(F.lit("lote "), i.cast("string"), F.lit("\n")).alias("text"), F.when(i % 2 == 0, F.array(F.when(i % 4 == 0, "| a |").otherwise(""))).alias("tables"), F.lit("por").alias("language"))
    batches = counts.select("o_orderkey", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (key % 3 == 0).cast("int"))), result).alias("results"))
    pages = lines.select("o_orderkey", k.alias("page_no"))
    singles = lines.select("o_orderkey", k.alias("page_no"), F.struct(F.col("l_returnflag").alias("text"), F.lit(None).cast("array<string>").alias("tables"), F.lit(None).cast("string").alias("language")).alias("result"))
    out = fallbacks.batch_results(pages, batches, singles, ["o_orderkey"])
    return out.select("o_orderkey", F.col("page_no").cast("int").alias("page_no"), "from_batch", "text", "has_tables", "language", F.size("tables").alias("n_tables"))


@query(f"select 'case-' || (doc_id // {PAGES}) || '_images' as folder, 'raster_page_' || lpad((doc_id % {PAGES} + 1)::varchar, 4, '0') || '.png' as file_name, octet_length(encode(text))::bigint as n_bytes, sha256(text) as digest from documents where doc_id % 4 = 0 and text <> ''")
def b3_raster_files(spark, d):
    i, folder = F.col("doc_id"), sinks.shared_folder(spark)
    rasters = table(spark, d, "documents").where(i % 4 == 0).select(F.concat(F.lit("case-"), F.floor(i / PAGES).cast("string"), F.lit("_images")).alias("folder"), file_tree.raster_name(i % PAGES + 1).alias("file_name"), F.col("text").alias("content"))
    file_tree.write_files(rasters, folder)
    return file_tree.read_files(spark, folder, "raster_page_*.png").select("folder", "file_name", "n_bytes", F.sha2("content", 256).alias("digest"))
