"""Queries over the index, figures, estimates and streams; those without SQL are state machines, folds or streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import forms
from ..functions.text import filled_lines
from ..operators import estimates, figures, index
from ..sources import sinks
from ..sources.tables import SQL, page_images, rubric_lines, table, with_tables
from ..streaming import audit
from .registry import query


@query("select page_no, num, 'image' as img_type, width, height, 'jpeg' as encoding, '7' || num as object_id from page_images where num % 7 <> 0".replace("select", with_tables("page_images") + " select", 1))
def a7_image_listing(spark, d):
    im = page_images(spark, d)
    kind = F.when(F.col("num") % 7 == 0, "smask").otherwise("image")
    row = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("page_no", "num")], kind, F.col("width").cast("string"), F.col("height").cast("string"), F.lit("rgb 3 8 JPEG no"), F.concat(F.lit("7"), F.col("num").cast("string")), F.lit("0"))
    text = im.groupBy("page_no").agg(F.concat(F.lit("page   num  type\n-----\nx y\n"), F.array_join(F.sort_array(F.collect_list(row)), "\n")).alias("listing")).withColumnRenamed("page_no", "k")
    return figures.image_listing(text, "k", "listing").withColumn("page_no", F.col("k")).withColumn("num", F.col("num").cast("long")).select("page_no", "num", "img_type", "width", "height", "encoding", "object_id")


_FILES = """case when p_partkey % 4 = 0 then null else 'doc' || p_partkey || '_full_sanitized.md' end as sanitized, case when p_partkey % 4 <> 0 and p_partkey % 3 = 0 then 'doc' || p_partkey || '_b_log_split.txt' end as log,
 case when p_partkey % 4 <> 0 and p_partkey % 3 = 0 then p_partkey end as openai, case when p_partkey % 4 <> 0 and p_partkey % 3 = 0 then p_partkey + 1 end as gemini,
 case when p_partkey % 4 = 0 then 'no sanitised copy' when p_partkey % 3 = 0 then 'estimate' when p_partkey % 3 = 1 then 'log without estimate' else 'no log' end as outcome"""


@query(f"select p_partkey as pdf_id, {_FILES} from part")
def a16_estimate_lookup(spark, d):
    k = F.col("p_partkey")
    stem, said = F.concat(F.lit("doc"), k.cast("string")), F.concat(F.lit("Total estimado (documentos selecionados / arquivo sanitizado): openai="), k.cast("string"), F.lit(" gemini="), (k + 1).cast("string"))
    parts = table(spark, d, "part").select(k.alias("pdf_id"), F.lit("in").alias("folder"), F.concat(stem, F.lit(".pdf")).alias("name"), stem.alias("stem"), said.alias("said"))
    one = lambda suffix, age, content: F.struct(F.concat("stem", F.lit(suffix)).alias("name"), F.lit(age).alias("mtime"), content.alias("content"))
    none, m = F.lit("nothing"), F.col("pdf_id")
    kind = F.array_compact(F.array(F.when(m % 4 != 0, one("_full_sanitized.md", 5, none)), F.when(m % 3 != 2, one("_a_log_split.txt", 9, none)), F.when(m % 3 == 0, one("_b_log_split.txt", 7, F.col("said")))))
    files = parts.select("folder", F.explode(kind).alias("f")).select("folder", "f.name", "f.mtime", "f.content")
    # the folder is the document's own here, or every file would meet every document
    own = lambda df, c: df.withColumn("folder", F.regexp_extract(c, r"^(doc\d+)", 1))
    return estimates.find_estimates(own(parts.select("pdf_id", "folder", "name"), "name"), own(files, "name"))


@query(f"{with_tables('page_images')}, w as (select page_no, num, width % 560 + 15.0 as c, max(width % 560 + 30) over (partition by page_no) as width from page_images), g as (select *, lag(c) over (partition by page_no order by c) as a from w), k as (select *, row_number() over (partition by page_no order by c - a desc, a desc) as rn from g where c - a >= width * 0.08::double), b as (select page_no, count(*) filter (where rn < 6) as n from k group by 1) select page_no, coalesce(n, 0) + 1 as n_bands from (select distinct page_no from page_images) left join b using (page_no)")
def g11_column_bands(spark, d):
    words = page_images(spark, d).select("page_no", (F.col("width") % 560).alias("x"), F.lit(30).alias("w"))
    return figures.column_bands(words, "page_no").groupBy("page_no").agg(F.count("*").alias("n_bands"))


@query("""select n_nationkey::varchar as pdf_id, substr(md5(n_nationkey::varchar), 1, 7) as doc_id, n_name || ' segunda linha' as titulo, 'Documento de Identificação' as tipo, '01/02/2020 10:30' as data_assinatura from nation
 union all select n_nationkey::varchar, reverse(substr(md5(n_nationkey::varchar), 1, 7)), 'Ata', 'Despacho', '03/04/2021 9:05' from nation""")
def e9_index_state(spark, d):
    k = F.col("n_nationkey")
    sig = F.substr(F.md5(k.cast("string")), F.lit(1), F.lit(7))
    rows = F.concat(F.lit("    Documento de\n"), sig, F.lit("  01/02/2020 10:30  "), F.rpad(F.col("n_name"), 40, " "), F.lit("Identificação\n     segunda linha\n"), F.reverse(sig), F.lit("  03/04/2021 9:05  Ata                                  Despacho\n"))
    text = F.concat(F.lit("capa\nSUMÁRIO\nId.   Data   Documento   Tipo\n"), rows, F.lit("Fls.: 3\n"))
    return index.parse_index(table(spark, d, "nation").select(k.cast("string").alias("pdf_id"), text.alias("text")))


def _boxes(spark, d):
    k = F.col("p_partkey")
    return page_images(spark, d).select("page_no", F.concat(F.lit("t"), F.col("num").cast("string")).alias("text"), (F.col("num") * 7 % 500).alias("x"), (F.col("num") * 13 % 200).alias("y"), (F.lit(10) + F.col("num") % 9).alias("height"))


@query()
def g8_reading_order(spark, d):
    return figures.reading_order(_boxes(spark, d), "page_no")


@query()
def j2_word_merge(spark, d):
    b = _boxes(spark, d).select("page_no", F.col("text").alias("word"), "x", "y", F.lit(30).alias("w"), F.col("height").alias("h"))
    number = F.row_number().over(Window.partitionBy("page_no").orderBy("x", "y", "word"))
    first = b.withColumn("source", F.lit(0)).withColumn("word_no", number).withColumn("conf", F.lit(0.5))
    second = b.withColumn("x", F.col("x") + F.col("y") % 40).withColumn("source", F.lit(1)).withColumn("word_no", number).withColumn("conf", F.when(F.col("y") % 2 == 0, 0.9).otherwise(0.1))
    return figures.merge_words(first.unionByName(second), "page_no")


@query()
def g15_merge_figures(spark, d):
    bodies = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.lit(842.0).alias("height"))
    captions = bodies.select("doc_id", (F.col("doc_id") * 37 % 842).alias("y"), F.lit(10).alias("x"), F.concat(F.lit("### Descrição da imagem\n\n"), F.col("doc_id").cast("string")).alias("caption"))
    return figures.merge_figures(bodies, captions, "doc_id")


@query()
def c22_duplicate_ratio(spark, d):
    t = F.col("text")
    # a figure's text is one line of its page, misread
    own = filled_lines(t)
    df = table(spark, d, "documents").select("doc_id", t.alias("native"), F.replace(F.coalesce(F.get(own, (F.col("doc_id") % F.greatest(F.size(own), F.lit(1))).cast("int")), F.lit("")), F.lit("e"), F.lit("c")).alias("ocr"))
    return figures.duplicate_text(df, "ocr", "native").select("doc_id", "duplicate")


@query("select event_id, case event_id % 4 when 0 then event_type when 1 then event_type || chr(10) || 'b' when 2 then event_type else '' end as said from events")
def e15_message_text(spark, d):
    e, t = table(spark, d, "events"), F.col("event_type")
    body = F.concat(F.lit('{"content":"'), t, F.lit('"}'))
    listed = F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"'), t, F.lit('"},{"type":"image"},{"type":"output_text","text":"b"}]}}]}'))
    shapes = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"message":'), body, F.lit("}"))).when(F.col("event_id") % 4 == 1, listed).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"output":"'), t, F.lit('"}'))).otherwise(F.lit("{}"))
    return e.select("event_id", figures.message_text(shapes).alias("said"))


@query("select event_id, 'a ' || event_type || ' b' as said from events")
def e14_control_tokens(spark, d):
    raw = F.concat(F.lit("<class_Text><x_12>a "), F.col("event_type"), F.lit("<bbox>[1, 2.5, 3,4]</bbox> b</class_Text><y_3>"))
    return table(spark, d, "events").select("event_id", figures.without_control_tokens(raw).alias("said"))


@query("select doc_id, ['poppler.pdftotext', 'poppler.pdftotext+tesseract', 'tesseract'][doc_id % 3 + 1] as library, 'CPU' as device from documents")
def l12_labels(spark, d):
    cls = F.get(F.array(F.lit("native"), F.lit("hybrid"), F.lit("image_page")), (F.col("doc_id") % 3).cast("int"))
    library = F.when(cls == "native", "poppler.pdftotext").when(cls == "hybrid", "poppler.pdftotext+tesseract").otherwise("tesseract")
    return table(spark, d, "documents").select("doc_id", library.alias("library"), F.lit("CPU").alias("device"))


@query("select c_custkey, upper(left(md5(c_name), 6)) as token, coalesce(nullif(regexp_extract(c_name, '(\\d+)', 1), ''), '') as digits, printf('%,d', c_custkey * 1000) as shown from customer".replace("printf('%,d', c_custkey * 1000)", "format('{:,}', c_custkey * 1000)"))
def i22_number_formats(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper(F.substr(F.md5("c_name"), F.lit(1), F.lit(6))).alias("token"), F.regexp_extract("c_name", r"(\d+)", 1).alias("digits"), F.format_number(F.col("c_custkey") * 1000, 0).alias("shown"))


@query(f"with {SQL['rubric_lines']} select l_orderkey, count(distinct amount) as n_amounts, cast(count(*) filter (where number >= '100' and length(number) = 3) as bigint) as n_deductions from rubric_lines group by l_orderkey")
def f6_order_summary(spark, d):
    r = rubric_lines(spark, d)
    return r.groupBy("l_orderkey").agg(F.countDistinct("amount").alias("n_amounts"), F.count_if(forms.number_key(F.col("number")) >= 100).alias("n_deductions"))


@query("""with o as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
 select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n_events, round(sum(value), 6) as value from s group by user_id, k""")
def n_sessions_batch(spark, d):
    return audit.sessions(table(spark, d, "events")).withColumn("value", F.round("value", 6))


@query("""with o as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o),
 g as (select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n_events, round(sum(value), 6) as value from s group by user_id, k) select * from g where "end" <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)""")
def stream_audit_sessions(spark, d):
    schema = table(spark, d, "events").schema
    stream = audit.sessions(audit.read_arriving(spark, d, schema, "events*.parquet"))
    folder = sinks.shared_folder(spark)
    audit.run_to_folder(stream, f"{folder}/sessions", f"{folder}/checkpoint")
    # sessions that may still grow when the stream ends are not given out
    return spark.read.schema(stream.schema).parquet(f"{folder}/sessions").withColumn("value", F.round("value", 6))
