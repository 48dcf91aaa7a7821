"""Queries over forms and over what a run writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms, reports
from ..functions import pages as page_rules
from ..functions import stamps
from ..operators import forms as form_ops
from ..operators import layout
from ..operators import pages as page_ops
from ..sources.tables import doc_index, docket, rubric_lines, table, with_tables
from .registry import query


@query("select c_custkey, c_name as nome, case when c_custkey % 2 = 0 then '1' || c_custkey end as cpf, case when c_custkey % 2 = 0 then c_mktsegment end as filiacao, case when c_custkey % 2 = 0 then 3 else 1 end / 6.0::double as fill_ratio, c_custkey % 2 = 0 as ok from customer")
def k7_generic_forms(spark, d):
    more = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\nCPF 1"), F.col("c_custkey").cast("string"), F.lit("  Filiação: "), F.col("c_mktsegment"))).otherwise("")
    text = F.concat(F.lit("REPÚBLICA\n\nNome: "), F.col("c_name"), F.lit("  Nascimento:"), more)
    f = form_ops.simple_form(table(spark, d, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t", "identidade")
    return f.select("c_custkey", F.col("fields")["Nome"].alias("nome"), F.col("fields")["CPF"].alias("cpf"), F.col("fields")["Filiação"].alias("filiacao"), "fill_ratio", "ok")


@query("select c_custkey, case when c_custkey % 3 = 2 then 'Outro' when c_custkey % 3 = 1 then 'SALDO' else 'Mae' end as label from customer")
def i18_canonical_keys(spark, d):
    label = F.get(F.array(F.lit("Mãe"), F.lit("Saldo"), F.lit("Outro")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", forms.canonical_label(label).alias("label"))


@query("""with p as (select p_partkey as k, p_partkey % 7 as h, p_partkey % 11 as r, p_partkey % 2 = 0 as a, p_partkey % 3 = 0 as b, p_partkey % 5 = 0 as c from part)
 select k, greatest(h / 6.0::double, case when r > 0 then least(1.0::double, 0.4::double + r * 0.05::double) else 0.0::double end, case when a and h > 0 then 0.55::double else 0.0::double end) as trct,
 greatest((h % 4) / 3.0::double, case when r >= 3 then 0.7::double else 0.0::double end, case when r >= 8 then 0.6::double else 0.0::double end) as register,
 least(greatest(case when h >= 3 then 0.7::double else 0.0::double end, case when a and b then 0.8::double else 0.0::double end, case when c and b then 0.5::double else 0.0::double end, case when h >= 1 then 0.45::double else 0.0::double end), case when c and r < 8 then 0.30::double else 1.0::double end, case when r < 3 then 0.35::double else 1.0::double end) as slip,
 greatest(case when a or b then 0.4::double else 0.0::double end, case when r >= 2 then 0.8::double else 0.0::double end, case when c and a then 0.6::double else 0.0::double end, case when r >= 5 then 0.9::double else 0.0::double end) as fund from p""")
def f11_fill_ratios(spark, d):
    k = F.col("p_partkey")
    h, r, a, b, c = k % 7, k % 11, k % 2 == 0, k % 3 == 0, k % 5 == 0
    return table(spark, d, "part").select(
        k.alias("k"), reports.fill_trct(h, r, a, h).alias("trct"), reports.fill_register(h % 4, r, r).alias("register"),
        reports.fill_slip(h, a, b, c, F.when(c, 2).otherwise(1), r).alias("slip"), reports.fill_fund(a, b, r, c).alias("fund"),
    )


@query("select event_id, case event_id % 4 when 0 then '' when 1 then '### Descrição da imagem' || chr(10) || event_type when 2 then '### Descrição da imagem 2' || chr(10) || event_type else '### Descrição da imagem' || chr(10) || event_type end as block from events")
def i21_caption_blocks(spark, d):
    k, t = F.col("event_id") % 4, F.col("event_type")
    said = F.when(k == 0, F.lit("  ")).when(k == 3, F.concat(F.lit("### Descrição da imagem\n"), t)).otherwise(t)
    return table(spark, d, "events").select("event_id", reports.caption_block(said, F.when(k == 2, 2)).alias("block"))


@query("select event_id, case when event_id % 3 = 0 then 'm' when event_id % 3 = 1 then 'm <details>x</details>' else 'm' || chr(10) || chr(10) || '<details><summary>Texto OCR completo</summary>' || chr(10) || chr(10) || event_type || chr(10) || chr(10) || '</details>' end as body from events")
def k12_ocr_details(spark, d):
    k = F.col("event_id") % 3
    return table(spark, d, "events").select("event_id", reports.with_details(F.when(k == 1, F.lit("m <details>x</details> ")).otherwise(F.lit("m\n")), F.when(k == 0, F.lit(" ")).otherwise(F.col("event_type"))).alias("body"))


@query("select event_id, 'PAGE_START processo=' || user_id || ' pagina=' || event_id || ' fls=' || case when event_id % 2 = 0 then cast(event_id as varchar) else '-' end || ' device=CPU library=poppler tipo=' || event_type || case when event_id % 3 = 0 then ' subtype=x' else '' end as line from events")
def b5_audit_lines(spark, d):
    e = F.col("event_id")
    line = reports.page_start_line(F.col("user_id"), e, F.when(e % 2 == 0, e), F.lit("CPU"), F.lit("poppler"), F.col("event_type"), F.when(e % 3 == 0, "x"))
    return table(spark, d, "events").select("event_id", line.alias("line"))


@query("select c_custkey, c_name || '_ocr_' || case when c_custkey % 2 = 0 then 'gpu' else 'cpu' end || '_nenhum.md' as name from customer")
def b2_output_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", reports.output_name(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " GPU ").otherwise(""), F.lit(None).cast("string")).alias("name"))


@query("""select doc_id, case when n_chars > 2000 or n_chars * 2 > 2000 then 'ALERTA: a contagem real do markdown ultrapassa 2,000 tokens (' || case when n_chars > 2000 then 'OpenAI: ' || format('{:,}', n_chars) || '; ' else '' end || 'Gemini: ' || format('{:,}', n_chars * 2) || ').' end as alert from documents""")
def l11_limit_alert(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", reports.limit_alert(n, n * 2, 2000).alias("alert"))


@query(f"""{with_tables('docket', 'doc_index')} select d.pdf_id, d.page_no, case when d.page_no % 2 = 0 then i.doc_id end as doc_id, i.doc_id is not null and regexp_matches(lower(strip_accents(i.tipo)), '^(intimacao|despacho|decisao|sentenca)($|[ (])') as exempt from docket d left join doc_index i on d.pdf_id = i.pdf_id and d.sig = i.doc_id""")
def d2_second_chance(spark, d):
    new, old = F.lit("Documento assinado eletronicamente por X - "), F.lit("Assinado eletronicamente por: X - Juntado em: 19/07/2022 - ")
    raw = F.concat(F.when(F.col("page_no") % 2 == 0, new).otherwise(old), "sig")
    p = docket(spark, d).select("pdf_id", F.col("page_no").cast("long").alias("page_no"), stamps.signature_ids(raw).alias("signature_ids"), stamps.stamp_ids(raw).alias("stamp_ids"))
    index = doc_index(spark, d)
    first = page_ops.index_lookup(p, index)
    second = page_ops.index_lookup(p, index, "stamp_ids").select("pdf_id", "page_no", F.col("tipo").alias("_second"))
    # the second chance counts for the exemption only
    both = first.join(second, ["pdf_id", "page_no"])
    return both.select("pdf_id", "page_no", "doc_id", page_rules.preserved(F.coalesce("tipo", "_second")).alias("exempt"))


def _listed(spark, d, line):
    """Texts of one line for each order line, by order."""
    rows = rubric_lines(spark, d).select("l_orderkey", F.struct("l_linenumber", "number", line.alias("t")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "\n").alias("t"))


@query(f"""{with_tables('rubric_lines')} select l_orderkey, count(*) as n_events, '10,00' as earnings, '2,00' as discounts, case when l_orderkey % 2 = 0 then '8,00' end as net, '12.345.678/0001-90' as company_id, 'ANA' as name,
 case when count(*) < 3 then 0.35::double when l_orderkey % 2 = 0 then 0.8::double else 0.7::double end as fill_ratio, count(*) >= 3 as ok from rubric_lines group by l_orderkey""")
def k5_pay_slips(spark, d):
    slip = _listed(spark, d, F.concat(F.lpad("number", 4, "0"), F.lit(" Verba "), F.col("amount")))
    top, net = F.lit("Recibo de Pagamento\nNome: ANA\nCNPJ: 12.345.678/0001-90\n"), F.when(F.col("l_orderkey") % 2 == 0, "\nValor Líquido 8,00").otherwise("")
    return form_ops.pay_slips(slip.withColumn("t", F.concat(top, "t", F.lit("\nTotal Vencimentos Total Descontos 10,00 2,00"), net)), "l_orderkey", "t")


@query(f"""{with_tables('rubric_lines')} select l_orderkey, 'ANA SOUZA' as name, '123.45678.90-1' as person_number, null::varchar as company_id, '1.000,00' as balance, count(*) as n_rows, case when count(*) >= 5 then 0.9::double when count(*) >= 2 then 0.8::double else 0.6::double end as fill_ratio, true as ok from rubric_lines group by l_orderkey""")
def k6_fund_statements(spark, d):
    rows = _listed(spark, d, F.concat(F.lit("05/06/2019 DEPOSITO "), F.col("number"), F.lit(" "), F.col("amount"), F.lit(" 9,99")))
    return form_ops.fund_statements(rows.withColumn("t", F.concat(F.lit("Nome: ANA SOUZA\nPIS 123.45678.90-1\nSALDO: R$ 1.000,00\n"), "t")), "l_orderkey", "t")


@query("""with c as (select c_custkey, c_mktsegment, c_custkey % 2 = 0 as paired from customer)
 select c_custkey, '01' as number, case when paired then '12.345.678/0001-90' else '02' end as value from c union all select c_custkey, '02', c_mktsegment from c where paired or (c_custkey > 49 and 40 + 4 * length(c_mktsegment) >= 80 - 8) union all select c_custkey, '10', '123' from c""")
def k3_numbered_fields(spark, d):
    k = F.col("c_custkey")
    # labels glued to their numbers above values that only their place tells apart, or labels with a number that reads as a value
    # and a second band that holds a word whose middle lies in it; up to 49 the values' line reads as a label itself
    top = F.when(k % 2 == 0, F.concat(F.lit("01CNPJ 02Nome\n"), F.lit("12.345.678/0001-90 "), "c_mktsegment")).otherwise(F.concat(F.lit("01 CNPJ 02 Nome\n"), k.cast("string"), F.lit(" "), "c_mktsegment"))
    text = F.concat(F.lit("IDENTIFICAÇÃO DO EMPREGADOR\n"), top, F.lit("\n10 PIS\n123\n50 Saldo 9,99\n"))
    words = layout.plain_words(table(spark, d, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t")
    # labels stand apart, and values right of all bands
    far = F.when((F.col("line_no") == 1) & (k % 2 == 0), F.col("x") * 10).when((F.col("line_no") == 2) & (k % 2 == 0), F.col("x") + 900).otherwise(F.col("x"))
    return form_ops.numbered_fields(words.withColumn("x", far), "c_custkey")
