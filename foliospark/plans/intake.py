"""Queries over the queue, tool reports, kinds, labels with values below and reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow
from ..operators import intake
from ..sources.tables import docket, page_images, table, with_tables
from .registry import query

_PATHS = "case doc_id % 4 when 0 then '/in//' when 1 then '/in/./' else '/in/' end || source || '/' || (doc_id % 300) || case doc_id % 5 when 0 then '.PDF' when 1 then '.txt' else '.pdf' end"
_D_QUEUE = f"q as (select p as path, min(doc_id) as place from (select doc_id, regexp_replace(regexp_replace({_PATHS}, '/(?:\\./)+', '/', 'g'), '/{{2,}}', '/', 'g') as p from documents) where lower(p) like '%.pdf' group by p)"


def _files(spark, d):
    m = F.col("doc_id")
    top = F.when(m % 4 == 0, "/in//").when(m % 4 == 1, "/in/./").otherwise("/in/")
    end = F.when(m % 5 == 0, ".PDF").when(m % 5 == 1, ".txt").otherwise(".pdf")
    return table(spark, d, "documents").select(F.concat(top, "source", F.lit("/"), (m % 300).cast("string"), end).alias("path"), m.alias("place"))


@query(f"with {_D_QUEUE} select * from q")
def a1_queue(spark, d):
    return intake.queue(_files(spark, d))


@query(f"with {_D_QUEUE} select * from q where place % 7 = 0")
def a2_missing(spark, d):
    queued = intake.queue(_files(spark, d))
    return intake.missing(queued, queued.where("place % 7 <> 0").select("path"))


_REPORT = "'Title:  ' || lang || chr(10) || 'Subtitle: x' || chr(10) || case when doc_id % 9 = 0 then '' else 'Pages:          ' || case when doc_id % 8 = 0 then 'many' else cast(doc_id % 70 as varchar) end || chr(10) end || 'Title: later'"


@query("select doc_id, lang as title, case when doc_id % 9 <> 0 and doc_id % 8 <> 0 then cast(doc_id % 70 as int) end as n_pages from documents")
def a6_info_fields(spark, d):
    m = F.col("doc_id")
    pages = F.when(m % 9 == 0, "").otherwise(F.concat(F.lit("Pages:          "), F.when(m % 8 == 0, "many").otherwise((m % 70).cast("string")), F.lit("\n")))
    report = F.concat(F.lit("Title:  "), "lang", F.lit("\nSubtitle: x\n"), pages, F.lit("Title: later"))
    return table(spark, d, "documents").select("doc_id", flow.info_field(report, "Title").alias("title"), flow.page_count(report).alias("n_pages"))


_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(f"""with p as (select doc_id, list_transform(string_split(replace(text, chr(10), chr(12)), chr(12)), lambda x: {_STRIP.format('x')}) as parts, doc_id % 5 + 1 as expected from documents), f as (select *, list_filter(parts, lambda x: x <> '') as filled from p)
 select doc_id, case when len(parts) > 1 then case when len(filled) = expected then md5(array_to_string(filled, chr(12))) when len(filled) = expected + 1 and parts[-1] = '' then md5(array_to_string(parts[1:expected], chr(12))) end end as pages from f""")
def a4_accepted_pages(spark, d):
    pages = flow.accepted_pages(F.replace("text", F.lit("\n"), F.lit("\f")), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(pages, "\f")).alias("pages"))


@query(f"{with_tables('page_images')}, f as (select page_no, num, case num % 3 when 0 then num when 1 then num - 1 else num + 40 end as i from page_images) select f.page_no, 'p-' || f.num || '-' || lpad(cast(i as varchar), cast(greatest(3, length(cast(i as varchar))) as integer), '0') || '.png' as file_name, coalesce(a.num, b.num) as num from f left join page_images a on a.page_no = f.page_no and a.num = i left join page_images b on b.page_no = f.page_no and b.num = i + 1")
def d5_image_of_file(spark, d):
    n = F.col("num")
    i = F.when(n % 3 == 0, n).when(n % 3 == 1, n - 1).otherwise(n + 40).cast("string")
    files = page_images(spark, d).select("page_no", F.concat(F.lit("p-"), n.cast("string"), F.lit("-"), F.lpad(i, F.greatest(F.length(i), F.lit(3)), F.lit("0")), F.lit(".png")).alias("file_name"))
    return intake.image_of_file(files, page_images(spark, d))


@query(f"{with_tables('page_images')} select num, case when num % 6 = 0 then num % 7000 < 4000 else (greatest(width, height) <= 120 and width * height <= 25000) or (width <= 150 and height <= 150) end as logo from page_images")
def a9_logo_file(spark, d):
    readable = lambda c: F.when(F.col("num") % 6 != 0, F.col(c))
    return page_images(spark, d).select("num", flow.logo_file(readable("width"), readable("height"), F.col("num") % 7000).alias("logo"))


@query("""select event_id, case event_id % 5 when 0 then 'recibo' when 1 then 'cnh' when 2 then 'identidade' when 3 then 'fgts' end as refined, case event_id % 3 when 0 then 'trct' when 1 then 'recibo' else 'fgts' end as form,
 event_id % 4 in (0, 1) as gpu_full, event_id % 2 = 1 as shown, cast(case when event_id % 3 = 0 then 1 when event_id % 20 < 8 then least(event_id % 6, 2) else greatest(1, event_id % 6) end as int) as pages_at_once,
 cast(case when event_id % 3 = 0 or event_id % 20 >= 12 then event_id % 16 when event_id % 20 < 8 then least(event_id % 16, 4) else least(event_id % 16, 8) end as int) as lines_at_once from events""")
def c25_flow_rules(spark, d):
    m = F.col("event_id")
    kind = F.when(m % 5 == 1, "identidade").when(m % 5 == 2, "identidade").when(m % 5 == 3, "fgts")
    said = F.when(m % 5 == 0, "Recibo de Pagamento").when(m % 5 == 1, "república SENATRAN").otherwise("nada")
    form = F.when(m % 3 == 0, "Termo de Homologação e recibo de pagamento").when(m % 3 == 1, "contracheque").otherwise("nada")
    message = F.when(m % 4 == 0, "onnx: CUDA_ERROR_OUT_OF_MEMORY").when(m % 4 == 1, "device Out Of Memory").when(m % 4 == 2, "out of paper")
    gpu, size = m % 3 != 0, (m % 20).cast("double")
    return table(spark, d, "events").select(
        "event_id", flow.refined_kind(kind, said).alias("refined"), flow.form_kind(form, F.lit("fgts")).alias("form"), flow.gpu_full(message).alias("gpu_full"), flow.console_line(F.when(m % 2 == 0, "PAGE_START 1").otherwise("other PAGE_")).alias("shown"),
        flow.batch_size((m % 6).cast("int"), gpu, size).alias("pages_at_once"), flow.line_batch((m % 16).cast("int"), gpu, size).alias("lines_at_once"),
    )


@query("""select c_custkey, case when c_custkey % 3 = 0 then '' else '1.0' || (c_custkey % 10) || ',50' end as money, case when c_custkey % 4 = 0 then '' else c_mktsegment || ' | x' end as after from customer""")
def e13_search(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("um\n"), F.when(k % 3 == 0, "Total Bruto nada\n").otherwise(F.concat(F.lit("TOTAL bruto  R$ 1.0"), (k % 10).cast("string"), F.lit(",50 e Total Bruto 9,99\n"))), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Cargo : "), "c_mktsegment", F.lit(" | x  \n"))), F.lit("fim"))
    return table(spark, d, "customer").select("c_custkey", flow.money_after(text, r"total\s+bruto\s+(?:R\$\s*)?([\d.]+,\d{2})").alias("money"), flow.line_after(text, "cargo").alias("after"))


@query("""with r as (select c_custkey, case c_custkey % 4 when 0 then repeat(' ', 10) || rpad(c_name, 50, ' ') || 'Ata' when 1 then repeat(' ', 70) || 'Um  dois   ' || c_name when 2 then c_name else '  ' || c_name || '  Ata' end as l from customer)
 select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then 'Um dois' when 2 then c_name else c_name end as title, case c_custkey % 4 when 0 then 'Ata' when 1 then c_name when 2 then '' else 'Ata' end as type from r join customer using (c_custkey)""")
def i15_title_and_type(spark, d):
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    rest = F.when(k == 0, F.concat(F.rpad(name, 50, " "), F.lit("Ata"))).when(k == 1, F.concat(F.lit("Um  dois   "), name)).when(k == 2, name).otherwise(F.concat(name, F.lit("  Ata")))
    line = F.concat(F.when(k == 0, " " * 10).when(k == 1, " " * 70).when(k == 2, "").otherwise("  "), rest)
    s = table(spark, d, "customer").select("c_custkey", flow.title_and_type(rest, line).alias("s"))
    return s.select("c_custkey", "s.title", "s.type")


@query("select c_custkey, case c_custkey % 3 when 0 then 'Mãe' when 1 then 'Mae' end as spelling from customer")
def i19_first_present(spark, d):
    k = F.col("c_custkey") % 3
    fields = F.when(k == 0, F.create_map(F.lit("Mãe"), F.lit("x"), F.lit("Mae"), F.lit("y"))).when(k == 1, F.create_map(F.lit("Mae"), F.lit("y"))).otherwise(F.create_map(F.lit("Pai"), F.lit("z")))
    return table(spark, d, "customer").select("c_custkey", flow.first_present(fields, ["Mãe", "Mae"]).alias("spelling"))


@query("select c_custkey, 'Nome' as label, c_name as value from customer union all select c_custkey, 'Nome da Mãe', 'M ' || c_custkey from customer where c_custkey % 2 = 0 union all select c_custkey, 'CPF', c_mktsegment from customer where c_custkey % 3 <> 0")
def k8_values_below(spark, d):
    k = F.col("c_custkey")
    mother = F.when(k % 2 == 0, F.concat(F.lit("Nome da Mãe\n\n M "), k.cast("string"), F.lit("\n"))).otherwise("Nome da Mãe:\n")
    text = F.concat(F.lit("x\nNOME :\n"), "c_name", F.lit("\n"), mother, F.lit("CPF\n"), F.when(k % 3 == 0, "").otherwise(F.concat("c_mktsegment", F.lit("\n"))), F.lit("nome\nCPF:"))
    return intake.values_below(table(spark, d, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t", ["Nome", "CPF", "Nome da Mãe"])


@query(f"{with_tables('docket')} select pdf_id, page_no, case when page_no % 2 = 0 then 'abc1234' else sig end as first_id from docket")
def g2_page_ids(spark, d):
    given = F.when(F.col("page_no") % 2 == 0, F.array(F.lit("ABC1234"), F.lit("abc1234")))
    return docket(spark, d).select("pdf_id", F.col("page_no").cast("long").alias("page_no"), F.try_element_at(intake.page_ids(given, F.col("raw_text")), F.lit(1)).alias("first_id"))


@query("""with b as (select l_orderkey, l_linenumber * 13 % 5 as y, l_suppkey as x, case when l_linenumber % 3 = 0 then 1 else 0 end as k, trim(case when l_linenumber = 2 then ' ' else l_returnflag || l_partkey end) as t from lineitem)
 select l_orderkey, string_agg(t, chr(10) || chr(10) order by y, x, k, t) as text from b where t <> '' group by 1""")
def g16_interleaved(spark, d):
    n = F.col("l_linenumber")
    b = table(spark, d, "lineitem").select("l_orderkey", (n * 13 % 5).alias("y"), F.col("l_suppkey").alias("x"), n.alias("n"), F.when(n == 2, " ").otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string"))).alias("text"))
    return intake.interleaved(b.where("n % 3 <> 0").drop("n"), b.where("n % 3 = 0").drop("n"), "l_orderkey")


@query(f"{with_tables('docket')} select pdf_id, cast(page_no // 2 as bigint) as fls, min(page_no) as page_no from docket where page_no % 5 <> 0 group by 1, 2")
def d14_folio_pages(spark, d):
    n = F.col("page_no")
    return intake.folio_pages(docket(spark, d).select("pdf_id", n.cast("long").alias("page_no"), F.when(n % 5 != 0, F.floor(n / 2)).cast("long").alias("fls")))


@query(f"{with_tables('docket')}, m as (select *, max(page_no) over (partition by pdf_id) as n, cast(right(pdf_id, 1) in ('1', '3', '5') as int) as odd from docket) select pdf_id, page_no from m where (odd = 1 and page_no > n - 40) or odd = 0")
def e10_index_pages(spark, d):
    n = F.col("page_no")
    odd = F.substr("pdf_id", F.length("pdf_id"), F.lit(1)).isin("1", "3", "5")
    # the marker stands on the last page of some documents, and on the first of all
    last = n == F.max(n).over(intake.Window.partitionBy("pdf_id"))
    pages = docket(spark, d).select("pdf_id", n.cast("long").alias("page_no"), F.when(odd & last, "SUMÁRIO x").otherwise("x").alias("text"))
    return intake.index_pages(pages, "SUMÁRIO").select("pdf_id", "page_no")
