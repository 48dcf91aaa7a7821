"""Queries over the formatters, tables without lines, the page driver and the sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formatters as fm
from ..operators import driver, layout, tables
from ..sources import sinks
from ..sources.tables import page_images, rubric_lines, table, with_tables
from .registry import query
from .reporting import _listed

_RUBRICS = with_tables("rubric_lines")
_DETAILS = "'\n\n<details><summary>Texto OCR completo</summary>\n\n' || t || '\n\n</details>'"


def _title(kind: str) -> str:
    return f"**Tipo documental**: {fm.KIND_LABELS[kind]}\n\n"


# -- formatters -----------------------------------------------------------------------------------------------------------------
@query(f"""{_RUBRICS}, g as (select l_orderkey, count(*) as n, string_agg(line, '\n' order by l_linenumber, number, line) as t, string_agg('\n| ' || number || ' | Verba | ' || substr(line, length(number) + 8) || ' |', '' order by l_linenumber, number, line) as r from rubric_lines group by 1)
 select l_orderkey, '{_title("trct")}' || case when n < 4 then t else '| Nº | Campo | Valor |\n| --- | --- | --- |' || r || {_DETAILS} end as markdown from g""")
def k10_termination_forms(spark, d):
    return _listed(spark, d, F.col("line")).select("l_orderkey", fm.formatted(F.col("t"), F.lit("trct")).alias("markdown"))


@query(f"""{_RUBRICS}, g as (select l_orderkey, count(*) as n, string_agg('0' || lpad(number, 3, '0') || ' ' || regexp_replace(line, '^[0-9]+ ', '') || ' 9,99', '\n' order by l_linenumber, number, line) || case when l_orderkey % 2 = 0 then '\nValor Líquido 8,00' else '' end as t,
  string_agg('\n| 0' || lpad(number, 3, '0') || ' | ' || regexp_replace(regexp_replace(line, '^[0-9]+ ', ''), ' [^ ]+$', '') || ' | ' || amount || ' | 9,99 |', '' order by l_linenumber, number, line) as r from rubric_lines group by 1)
 select l_orderkey, '{_title("recibo")}' || case when n < 2 then t else '| Código | Descrição | Vencimentos | Descontos |\n| --- | --- | --- | --- |' || r || case when l_orderkey % 2 = 0 then '\n\n**Valor líquido**: 8,00' else '' end || {_DETAILS} end as markdown from g""")
def k10_pay_slips(spark, d):
    line = F.concat(F.lit("0"), F.lpad("number", 3, "0"), F.lit(" "), F.regexp_replace("line", "^[0-9]+ ", ""), F.lit(" 9,99"))
    text = F.concat("t", F.when(F.col("l_orderkey") % 2 == 0, "\nValor Líquido 8,00").otherwise(""))
    return _listed(spark, d, line).select("l_orderkey", fm.formatted(text, F.lit("recibo")).alias("markdown"))


@query(f"""{_RUBRICS}, g as (select l_orderkey, count(*) as n, case when l_orderkey % 2 = 0 then 'Nome: ANA\n' else '' end || string_agg('05/06/2019 DEPOSITO ' || number || ' ' || amount || ' 9,99', '\n' order by l_linenumber, number, amount) as t,
  string_agg('\n| 05/06/2019 | DEPOSITO ' || number || ' | ' || amount || ' | 9,99 |', '' order by l_linenumber, number, amount) as r from rubric_lines group by 1)
 select l_orderkey, '{_title("fgts")}' || case when l_orderkey % 2 = 0 then '| Campo | Valor |\n| --- | --- |\n| Nome | ANA |' || {_DETAILS} else t end
  || case when n < 2 then '' else '\n\n### Histórico dos Lançamentos\n\n| Data | Descrição | Valor | Total |\n| --- | --- | --- | --- |' || r end as markdown from g""")
def k10_fund_statements(spark, d):
    rows = _listed(spark, d, F.concat(F.lit("05/06/2019 DEPOSITO "), "number", F.lit(" "), "amount", F.lit(" 9,99")))
    return rows.select("l_orderkey", fm.formatted(F.concat(F.when(F.col("l_orderkey") % 2 == 0, "Nome: ANA\n").otherwise(""), "t"), F.lit("fgts")).alias("markdown"))


@query(f"""with c as (select c_custkey, c_custkey % 3 as k, c_custkey % 2 = 1 as odd, c_name, case c_custkey % 3 when 0 then 'NOME: ' || c_name when 1 then 'NOME\n' || c_name else 'NOME\nCPF 9' end || case when c_custkey % 2 = 1 then '\nDATA DISPENSA - 01/02/2020' else '' end as t from customer)
 select c_custkey, '{_title("cd_sd")}| Campo | Valor |\n| --- | --- |' || case when k < 2 then '\n| Nome | ' || c_name || ' |' else '\n| CPF | 9 |' end || case when odd then '\n| Data Dispensa | 01/02/2020 |' else '' end || {_DETAILS} as markdown from c""")
def k10_keyed_forms(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, F.concat(F.lit("NOME: "), "c_name")).when(k % 3 == 1, F.concat(F.lit("NOME\n"), "c_name")).otherwise("NOME\nCPF 9"), F.when(k % 2 == 1, "\nDATA DISPENSA - 01/02/2020").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", fm.formatted(text, F.lit("cd_sd")).alias("markdown"))


# -- amounts, events and history read as columns ------------------------------------------------------------------------------
def _said(rows):
    return F.array_join(F.transform(rows, lambda r: F.concat_ws("|", *[r[n] for n in ("number", "label", "value")])), ";")


@query(f"""{_RUBRICS}, g as (select l_orderkey, string_agg(number || '|' || regexp_replace(regexp_replace(line, '^[0-9]+ ', ''), ' [^ ]+$', '') || '|' || amount, ';' order by l_linenumber, number, line) filter (where cast(number as int) < 100) as e,
  string_agg(number || '|' || regexp_replace(regexp_replace(line, '^[0-9]+ ', ''), ' [^ ]+$', '') || '|' || amount, ';' order by l_linenumber, number, line) filter (where cast(number as int) >= 100) as d, count(*) filter (where cast(number as int) < 100) as n from rubric_lines group by 1)
 select l_orderkey, coalesce(concat_ws(';', e, case when l_orderkey % 2 = 0 then '|TOTAL BRUTO|5,00' end), '') as earnings, concat_ws(';', d, '|VALOR LÍQUIDO|1,00') as deductions, cast(ceil((n + case when l_orderkey % 2 = 0 then 1 else 0 end) / 3) as bigint) as n_rows from g""")
def k3_amounts(spark, d):
    text = F.concat(F.lit("48 Antes 1,00\nDiscriminação das Verbas\n"), "t", F.when(F.col("l_orderkey") % 2 == 0, "\nTOTAL BRUTO 5,00").otherwise(""), F.lit("\nRegistro: 1\n99 Depois 1,00\nvalor líquido | 1,00"))
    a = _listed(spark, d, F.col("line")).select("l_orderkey", fm.amounts(text).alias("a"))
    return a.select("l_orderkey", _said(F.col("a.earnings")).alias("earnings"), _said(F.col("a.deductions")).alias("deductions"), F.size(fm.amount_cells(F.col("a.earnings"))).cast("long").alias("n_rows"))


@query(f"""{_RUBRICS} select l_orderkey, string_agg(case when l_linenumber % 2 = 0 then '' else '0' || lpad(number, 3, '0') end || '|' || regexp_replace(regexp_replace(line, '^[0-9]+ ', ''), ' [^ ]+$', '') || '||' || amount || '|', ';' order by l_linenumber, number, line) as events from rubric_lines group by 1""")
def k5_slip_events(spark, d):
    code = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit("0"), F.lpad("number", 3, "0"), F.lit(" ")))
    text = F.concat(F.lit("Nada\nCódigo Descrição\n"), "t", F.lit("\nMensagens\n0001 Depois 1,00"))
    rows = _listed(spark, d, F.concat(code, F.regexp_replace("line", "^[0-9]+ ", ""))).select("l_orderkey", fm.slip_events(text).alias("e"))
    return rows.select("l_orderkey", F.array_join(F.transform("e", lambda e: F.concat_ws("|", *[e[n] for n in ("code", "description", "reference", "amount", "discount")])), ";").alias("events"))


@query(f"""{_RUBRICS}, r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, number, amount) as k, count(*) over (partition by l_orderkey) as n from rubric_lines)
 select a.l_orderkey, a.k, 'Verba' || a.number || 'x' as description, case when a.k % 2 = 0 then '7' else '' end as reference, coalesce(b.amount, '') as amount from r a left join r b on a.l_orderkey = b.l_orderkey and b.k = a.k + 1 where a.n > 1""")
def k5_column_events(spark, d):
    r = rubric_lines(spark, d)
    item = F.struct("l_linenumber", "number", "amount")
    own = r.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("r"))
    names = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("Verba"), x["number"], F.lit("x"), F.when(i % 2 == 1, " 7").otherwise(""))), "\n")
    values = F.array_join(F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["amount"]), "\n")
    events = own.select("l_orderkey", F.posexplode(fm.column_events(F.concat(F.lit("x\nRecibo de Pagamento\nDescrição\n"), names, F.lit("\nVencimentos\n"), values, F.lit("\nfim")))).alias("i", "e"))
    return events.select("l_orderkey", (F.col("i") + 1).cast("long").alias("k"), "e.description", "e.reference", "e.amount")


@query(f"""{_RUBRICS}, r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, number, amount) as k from rubric_lines)
 select l_orderkey, k, case when k % 31 < 10 then '0' else '' end || (k % 31) || '/01/2025' as date, 'DEPOSITO ' || number as description, amount, '9,' || lpad(cast(k % 100 as varchar), 2, '0') as balance from r union all select distinct l_orderkey, 0, '', 'SALDO ANTERIOR', '', '9,00' from r""")
def k6_column_history(spark, d):
    own = rubric_lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "number", "amount"))).alias("r"))
    column = lambda f: F.array_join(F.transform("r", f), "\n")
    dates, names, values = column(lambda x, i: F.concat(F.lpad(((i + 1) % 31).cast("string"), 2, "0"), F.lit("/01/2025"))), column(lambda x, i: F.concat(F.lit("DEPOSITO "), x["number"])), column(lambda x, i: x["amount"])
    balances = column(lambda x, i: F.concat(F.lit("9,"), F.lpad(((i + 1) % 100).cast("string"), 2, "0")))
    text = F.concat(F.lit("Histórico dos Lançamentos\n08/04/2026\n"), dates, F.lit("\nDescrição dos lançamentos\nSALDO ANTERIOR\n"), names, F.lit("\nValor R$\n"), values, F.lit("\nTotal R$\n9,00\n"), balances)
    rows = own.select("l_orderkey", F.posexplode(fm.column_history(text)).alias("k", "h"))
    return rows.select("l_orderkey", F.col("k").cast("long").alias("k"), "h.date", "h.description", "h.amount", "h.balance")


# -- tables below headings ------------------------------------------------------------------------------------------------------
def _words(spark, d, heads, cells):
    """Words of pages, one for each order: heading lines of (word, x), then the cells of a line for each order line."""
    word = lambda line, no, w, x: F.struct(line.cast("int").alias("line_no"), F.lit(no).alias("word_no"), w.alias("word"), F.lit(x).alias("x"), (F.length(w) * 8).alias("w"))
    r = rubric_lines(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "number", "line")))
    body = F.array(*[word(F.col("k") + len(heads), n, w, x) for n, (w, x) in enumerate(cells)])
    top = F.array(*[word(F.lit(k), n, F.lit(w), x) for k, head in enumerate(heads) for n, (w, x) in enumerate(head)])
    return r.select("l_orderkey", F.explode(F.when(F.col("k") == 1, F.concat(top, body)).otherwise(body)).alias("x")).select("l_orderkey", "x.*")


@query(f"""{_RUBRICS} select l_orderkey, 'Alterações de Sindicato' as title, count(*) as n_rows, string_agg('05/06/2019|' || number || ' ' || amount, ';' order by l_linenumber, number, line) as cells from rubric_lines group by 1""")
def k9_named_tables(spark, d):
    heads = [[("Alterações", 0), ("de", 90), ("Sindicato", 120)], [("Inicio", 0), ("Descrição", 300)]]
    found = tables.named_tables(_words(spark, d, heads, [(F.lit("05/06/2019"), 0), (F.col("number"), 320), (F.col("amount"), 360)]), "l_orderkey")
    return found.select("l_orderkey", "title", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query(f"""{_RUBRICS} select l_orderkey, k, case when k % 2 = 0 then number else '' end as code, 'Verba' as description, amount from (select *, row_number() over (partition by l_orderkey order by l_linenumber, number, line) as k from rubric_lines)""")
def k5_banded_events(spark, d):
    heads = [[("Nada", 0)], [("Código", 0), ("Descricao", 100), ("Referência", 300), ("Vencimentos", 400), ("Descontos", 560)]]
    code = F.when(F.col("k") % 2 == 0, F.col("number")).otherwise(F.lit(""))
    words = _words(spark, d, heads, [(code, 0), (F.lit("Verba"), 100), (F.col("amount"), 400)]).where("word <> ''")
    e = tables.slip_events(words, "l_orderkey")
    return e.select("l_orderkey", (F.col("line_no") - len(heads)).cast("long").alias("k"), "code", "description", "amount")


@query("""with p as (select p_partkey, p_partkey % 3 + 2 as n from part), c as (select p_partkey, n, r, c from p, range(3) a(r), range(4) b(c) where c < n and n > 2)
 select p_partkey, r as row, c as col, 'a' || r || ' b' || c as text, cast(case when c = n - 2 then 2 else 1 end as bigint) as colspan from c where c < n - 1""")
def j4_ruled_tables(spark, d):
    part, n = table(spark, d, "part"), F.col("p_partkey") % 3 + 2
    # each line was seen twice; the last column is empty; pages with two columns or fewer have no grid
    twice = lambda axis, places: F.transform(places, lambda k: F.struct(F.lit(axis).alias("axis"), (F.floor(k / 2) * 100 + k % 2 * 5).alias("at")))
    marks = part.select("p_partkey", F.explode(F.concat(twice("x", F.sequence(F.lit(0), (n * 2 + 1))), twice("y", F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))).alias("m")).select("p_partkey", "m.*")
    word = lambda r, c, k: F.struct(F.concat(F.lit("ab"[k]), (r if k == 0 else c).cast("string")).alias("word"), (c * 100 + 20 + 30 * k).alias("x"), (r * 100 + 30).alias("y"), F.lit(20).alias("w"), F.lit(10).alias("h"))
    rows = part.select("p_partkey", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).select("p_partkey", "r", F.explode(F.sequence(F.lit(0), (F.col("n") - 2).cast("int"))).alias("c"))
    words = rows.select("p_partkey", F.explode(F.array(word(F.col("r"), F.col("c"), 0), word(F.col("r"), F.col("c"), 1))).alias("w")).select("p_partkey", "w.*")
    return layout.ruled_tables(marks, words, "p_partkey", least_cols=3)


# -- the page driver ------------------------------------------------------------------------------------------------------------
_STRIP = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(f"""select doc_id, case doc_id % 3 when 0 then 'ctps' when 1 then 'act' else 'outro' end as kind, md5(case when {_STRIP} = '' then '' else case doc_id % 3 when 0 then '{_title("ctps")}' when 1 then '{_title("act")}' else '' end || {_STRIP} end) as said from documents""")
def l3_native_pages(spark, d):
    k = F.col("doc_id") % 3
    pages = table(spark, d, "documents").select("doc_id", F.col("text").alias("residual_text"), F.when(k == 0, "ctps").when(k == 1, "act").otherwise("outro").alias("doc_kind"))
    return driver.native_pages(pages).select("doc_id", "kind", F.md5("text").alias("said"))


@query("""select doc_id, md5(trim(case when doc_id % 4 = 1 then text || '\n\n### Descrição da imagem\nFoto ' || doc_id else text end, e' \\n\\t\\r')) as said, cast(doc_id % 4 = 1 as bigint) as images_described from documents""")
def l4_hybrid_pages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("body"), F.lit(842.0).alias("height"))
    k, none = F.col("doc_id") % 4, F.lit(None)
    # a small file, a photograph, a logo, and a covered figure
    figures = docs.select(
        "doc_id", F.when(k == 0, 2999).otherwise(3000).alias("size"), (k == 2).alias("logo"), F.lit(False).alias("banner"), (k == 3).alias("covered"), none.cast("string").alias("ocr_text"), none.cast("array<string>").alias("tables"),
        F.concat(F.lit("Foto "), F.col("doc_id").cast("string")).alias("caption"), none.cast("int").alias("y"), none.cast("int").alias("x"),
    )
    return driver.hybrid_pages(docs, figures, "doc_id").select("doc_id", F.md5("text").alias("said"), "images_described")


@query("""with e as (select event_id, event_id % 6 as k, event_type || ' com um texto que basta para ser lido por todos' as t from events)
 select event_id, case k when 0 then t when 1 then t when 2 then 'resto' when 3 then '' when 4 then '### Descrição da imagem' || chr(10) || 'Uma foto' else '# F' end as said, case k when 4 then 'image_describe' when 5 then 'template' end as source,
  k in (2, 3) as ocr_failed, case k when 2 then 'ocr_failed: boom' when 3 then 'empty_after_ocr' end as reason, cast(k = 4 as bigint) as images_described, k = 5 as has_tables, case when k in (0, 1) then cast(event_id % 9 + 1 as bigint) end as fls from e""".replace("|| ' com um texto que basta para ser lido por todos'", "|| ' com um texto que basta para ser lido por todos Fls.: ' || (event_id % 9 + 1)"))
def l5_image_pages(spark, d):
    k = F.col("event_id") % 6
    said = F.concat("event_type", F.lit(" com um texto que basta para ser lido por todos Fls.: "), (F.col("event_id") % 9 + 1).cast("string"))
    none = F.lit(None)
    texts = none.cast("array<string>")
    pages = table(spark, d, "events").select(
        "event_id", F.when(k == 5, "fgts").alias("doc_kind"), F.lit(False).alias("forced"), F.when(k == 2, " resto ").alias("residual_text"), none.cast("long").alias("fls"), F.when(k == 0, said).alias("ocr_text"), texts.alias("tables"),
        F.when(k.isin(1, 2), "boom").alias("ocr_error"), F.when(k == 1, said).alias("retry_text"), texts.alias("retry_tables"), none.cast("string").alias("retry_error"), none.cast("string").alias("second_text"), texts.alias("second_tables"),
        F.when(k == 5, F.struct(F.lit(True).alias("ok"), F.lit("# F").alias("markdown"), F.lit("template").alias("source"), F.lit(0.9).alias("fill_ratio"), F.lit(3).alias("n_table_rows"))).alias("filled"),
        F.when(k.isin(4, 5), "Uma foto").alias("caption"), none.cast("struct<text:string,images_described:bigint,has_tables:boolean>").alias("figures"),
    )
    return driver.image_pages(pages).select("event_id", F.col("text").alias("said"), "source", "ocr_failed", "reason", "images_described", "has_tables", "fls")


@query(f"""{with_tables('page_images')}, f as (select page_no, num, num % 3 <> 0 as told, count(*) over (partition by page_no) as n, count(*) filter (where num % 3 <> 0) over (partition by page_no) as several, count(*) filter (where num % 3 <> 0) over (partition by page_no order by num) as k from page_images)
 select page_no, coalesce(string_agg('### Descrição da imagem' || case when several >= 2 then ' ' || k else '' end || chr(10) || 'Foto ' || num, chr(10) || chr(10) order by num) filter (where told), '') as said, count(*) filter (where told) as images_described from f where n >= 2 group by 1""")
def l6_page_figures(spark, d):
    n = F.col("num")
    figures = page_images(spark, d).select("page_no", "num", n.alias("y"), F.lit(0).alias("x"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("array<string>").alias("tables"), F.when(n % 3 != 0, F.concat(F.lit("Foto "), n.cast("string"))).alias("caption"))
    return driver.page_figures(figures, "page_no").select("page_no", F.col("text").alias("said"), "images_described")


@query("""select event_id, case when event_id % 5 = 0 then 'resto' else event_type || ' lido' end as said, event_id % 5 = 0 as ocr_failed, case when event_id % 5 = 0 then 'boom' end as reason, cast(case when event_id % 5 = 0 then 1 else 2 end as int) as word_count, cast(case when event_id % 5 = 0 then 5 else length(event_type) + 5 end as int) as char_count from events""")
def l2_settled_pages(spark, d):
    broken = F.col("event_id") % 5 == 0
    pages = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" lido")).alias("text"), F.lit(" resto ").alias("residual_text"), F.when(broken, "boom").alias("error"), F.lit(False).alias("ocr_failed"), F.lit(None).cast("string").alias("reason"))
    return driver.settled(pages).select("event_id", F.col("text").alias("said"), "ocr_failed", "reason", "word_count", "char_count")


# -- sinks ----------------------------------------------------------------------------------------------------------------------
@query("select replace(n_name, ' ', '_') || '.md' as file_name, '# ' || n_name || '\n\n' || n_nationkey || '\n' as markdown from nation")
def b1_markdown_files(spark, d):
    folder = sinks.shared_folder(spark)
    sinks.write_markdown(table(spark, d, "nation").select(F.concat("n_name", F.lit(".md")).alias("file_name"), F.concat(F.lit("# "), "n_name", F.lit("\n\n"), F.col("n_nationkey").cast("string"), F.lit("\n")).alias("markdown")), folder)
    return sinks.read_markdown(spark, folder)


@query("select 'case_' || c_nationkey as case_file, count(*) * 2 as n_lines, count(distinct c_custkey) as n_pages from customer group by 1")
def b5_audit_files(spark, d):
    folder, lines = sinks.shared_folder(spark), table(spark, d, "customer").select(F.concat(F.lit("case/"), F.col("c_nationkey").cast("string")).alias("case_id"), F.concat(F.lit("PAGE_END pagina="), F.col("c_custkey").cast("string")).alias("line"))
    for _ in range(2):
        sinks.append_audit(lines, folder)
    return sinks.read_audit(spark, folder).groupBy("case_file").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line").alias("n_pages"))
