"""Queries over runs: progress events, ruled tables from pixels, circuit breakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatters, pages
from ..operators import driver, layout, progress, rasters, run
from ..sources import sinks
from ..sources.tables import PAGES, doc_index, docket, rubric_lines, table, with_tables
from ..streaming import audit, breaker
from .catalogue import _D_CLASS, _D_OVERLAY, _D_USABLE, _classes, _d_has, _d_norm, _d_residue
from .registry import query


@query(f"""{_D_CLASS}, q as (select 'case-' || (doc_id // {PAGES}) as pdf_id, doc_id % {PAGES} + 1 as page_no, page_class, doc_id % 11 = 0 as forced from cls), t as (select pdf_id, count(*) as total from q group by pdf_id)
 select pdf_id, cast(row_number() over (partition by pdf_id order by page_no) as int) as place, 'page' as kind, page_no as page, total, null::bigint as native_pages, null::bigint as hybrid_pages, null::bigint as image_pages, null::bigint as force_ocr_skipped from q join t using (pdf_id)
 union all select pdf_id, 0, 'classification', 0, count(*), count(*) filter (page_class = 'native'), count(*) filter (page_class = 'hybrid'), count(*) filter (page_class = 'image_page'), count(*) filter (forced and page_class <> 'image_page') from q group by pdf_id""")
def b10_progress_events(spark, d):
    judged = _classes(spark, d).select(F.concat(F.lit("case-"), F.floor(F.col("doc_id") / PAGES).cast("string")).alias("pdf_id"), (F.col("doc_id") % PAGES + 1).alias("page_no"), "page_class", "forced")
    return progress.events(judged)


def _ruled_page(k, w):
    """Gray paper, ``w`` wide and 100 high, with lines of two pixels, strokes too short for a line, and no horizontal lines on every fourth page."""
    dark, paper = lambda n: F.repeat(F.lit("10"), F.lit(n)), lambda n: F.repeat(F.lit("E0"), F.lit(n))
    row = lambda *shades: F.substring(F.repeat(F.concat(*shades), F.lit(7)), F.lit(1), (w * 2).cast("int"))
    plain, stroke = row(paper(5), dark(2), paper(33)), row(paper(5), dark(2), paper(5), dark(17), paper(11))
    line = F.when(k % 4 > 0, F.repeat(F.lit("10"), w.cast("int"))).otherwise(plain)
    # three bands of 30 rows and the first ten of a fourth
    top = F.concat(F.repeat(plain, F.lit(4)), F.repeat(line, F.lit(2)), F.repeat(plain, F.lit(4)))
    band = F.concat(top, F.repeat(plain, F.lit(5)), stroke, F.repeat(plain, F.lit(14)))
    return F.unhex(F.concat(F.repeat(band, F.lit(3)), top))


@query("""with p as (select p_partkey, 165 + p_partkey % 3 * 40 as w from part where p_partkey % 4 > 0), g as (select p_partkey, r, c from p, range(3) a(r), range(5) b(c) where (c + 1) * 40 + 5 < w)
 select p_partkey, r as row, c as col, 'w' || r || c as text, 1::bigint as colspan from g""")
def j4_raster_tables(spark, d):
    k = F.col("p_partkey")
    w = F.lit(165) + k % 3 * 40
    # a part is a few bytes and its page 20 KB: parts are dealt out before they are drawn
    parts = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    drawn = parts.select("p_partkey", w.alias("width"), F.lit(100).alias("height"), _ruled_page(k, w).alias("pixels"))
    marks = rasters.ruling_lines(drawn, "p_partkey")
    cells = parts.select("p_partkey", w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).select("p_partkey", "w", "r", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")).where("(c + 1) * 40 + 5 < w")
    words = cells.select("p_partkey", F.concat(F.lit("w"), F.col("r").cast("string"), F.col("c").cast("string")).alias("word"), (F.col("c") * 40 + 12).alias("x"), (F.col("r") * 30 + 10).alias("y"), F.lit(16).alias("w"), F.lit(8).alias("h"))
    found = layout.ruled_tables(marks, words, "p_partkey")
    return found.select("p_partkey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text", F.col("colspan").cast("long").alias("colspan"))


#: Failures in a row and seconds of the cool-down in both queries below.
FAILURES, COOL = 2, 6 * 3600


def _changes(upto: str = "") -> str:
    """The changes of every user's events by SQL; those of timers only where they end before ``upto``."""
    cool = f"interval {COOL} seconds"
    return f"""with o as (select user_id, ts, event_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as k from events),
 s as (select *, case when ok then 0 else k - coalesce(max(case when ok then k end) over (partition by user_id order by k rows unbounded preceding), 0) end as streak, lag(ts) over (partition by user_id order by k) as earlier, lead(ts) over (partition by user_id order by k) as later, lead(ok) over (partition by user_id order by k) as later_ok from o),
 h as (select * from s where streak >= {FAILURES})
 select user_id::varchar as endpoint, ts, 'open' as state, 'failures' as reason from h where streak = {FAILURES} or ts > earlier + {cool}
 union all select user_id::varchar, ts + {cool}, 'closed', 'cool-down' from h where (later is null or later > ts + {cool}){upto}
 union all select user_id::varchar, later, 'closed', 'success' from h where later_ok and later <= ts + {cool}"""


def _calls(events):
    return events.select(F.col("user_id").alias("endpoint"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("call_id"))


@query(_changes())
def m9_breaker_changes(spark, d):
    return breaker.changes(_calls(table(spark, d, "events")), FAILURES, COOL)


# a timer of the stream runs out if the last watermark has passed it
@query(_changes(f" and (later is not null or ts + interval {COOL} seconds < (select date_trunc('milliseconds', max(ts)) - interval 1 hour from events))"))
def m9_breaker_stream(spark, d):
    folder = sinks.shared_folder(spark)
    stream = breaker.streamed(_calls(audit.read_arriving(spark, d, table(spark, d, "events").schema, "events*.parquet")), FAILURES, COOL)
    audit.run_to_folder(stream, f"{folder}/changes", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/changes")


_RUN_CLASS = f"""{with_tables('docket', 'doc_index')}, r as (select pdf_id, page_no, doc_id, sig, {_d_residue('raw_text')} as t from docket),
 f as (select r.*, coalesce({_d_has(_d_norm('tipo') + " || ' ' || " + _d_norm('titulo'), pages.FORCED)}, false) as forced, case when r.doc_id % 3 = 0 then 1 else 0 end as figures from r left join doc_index i on i.pdf_id = r.pdf_id and i.doc_id = r.sig),
 u as (select *, {_D_OVERLAY('t')} as overlay, {_D_USABLE('t')} as usable from f),
 k as (select *, case when (forced and not usable) or overlay then 'image_page' when usable then case when figures > 0 then 'hybrid' else 'native' end when figures > 0 then 'image_page' else 'native' end as page_class from u)"""


@query(f"""{_RUN_CLASS} select pdf_id, cast(count(*) as bigint) as total_pages, count(*) filter (page_class = 'native') as native_pages, count(*) filter (page_class = 'hybrid') as hybrid_pages, count(*) filter (page_class = 'image_page') as image_pages,
 count(*) filter (page_class = 'image_page' and doc_id % 5 = 1 or doc_id % 17 = 0) as ocr_failed_pages, count(*) as n_sections, true as titled, true as counted from k group by pdf_id""")
def l1_documents(spark, d):
    i = F.col("doc_id")
    source = docket(spark, d)
    keys = source.select("pdf_id", "page_no", "doc_id")
    # every third page has a figure of 700 by 900 pixels in its middle, every fifth can't be read, every seventeenth ends in an error
    third = keys.where(i % 3 == 0)
    none = F.lit(None)
    images = third.select("pdf_id", "page_no", F.lit(700).alias("width"), F.lit(900).alias("height"), F.lit(300.0).alias("y"), F.lit(300.0).alias("display_width"), F.lit(385.0).alias("display_height"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    figures = third.select("pdf_id", "page_no", i.alias("num"), F.lit(9000).alias("size"), F.concat(F.lit("Foto "), i.cast("string")).alias("caption"), F.lit(300.0).alias("y"), F.lit(90.0).alias("x"))
    engine = keys.select("pdf_id", "page_no", F.when(i % 5 != 1, F.concat(F.lit("texto lido da página "), i.cast("string"))).alias("ocr_text"), F.when(i % 5 == 1, "boom").otherwise(none).alias("ocr_error"), F.when(i % 17 == 0, "late").otherwise(none).alias("error"))
    out = run.documents(source.select("pdf_id", "page_no", "raw_text"), doc_index(spark, d), images, figures, engine)
    sections = F.size(F.regexp_extract_all("markdown", F.lit("(?m)^## Página [0-9]+ — Fls\\.: "), F.lit(0))).cast("long")
    titled = F.col("markdown").startswith(F.concat(F.lit("# Documento: "), F.col("pdf_id"), F.lit("\n\n")))
    return out.select("pdf_id", "total_pages", "native_pages", "hybrid_pages", "image_pages", "ocr_failed_pages", sections.alias("n_sections"), titled.alias("titled"), F.col("markdown").rlike("\n- \\*\\*Tokens Gemini\\*\\*: [0-9,]+$").alias("counted"))


# -- forms from templates and models -----------------------------------------------------------------------------------------------
_DETAILS = "{} || chr(10) || chr(10) || '<details><summary>Texto OCR completo</summary>' || chr(10) || chr(10) || {} || chr(10) || chr(10) || '</details>'"
_FORMS = ", ".join(f"'{k}'" for k in driver.FORM_KINDS)
_TEMPLATES = f"""with o as (select o_orderkey, o_custkey, ['trct', 'fgts', 'outro', null][o_orderkey % 4 + 1] as kind, case when o_orderkey % 5 = 0 then '' else 'texto ' || o_custkey end as said, '# F' || o_orderkey as md, (o_orderkey % 10)::double / 10 as ratio, (o_custkey % 7)::int as n from orders),
 r as (select *, case when not coalesce(kind in ({_FORMS}), false) then 'unknown_kind' when said = '' then 'empty_ocr' end as reason from o),
 t as (select *, reason is null and ratio >= 0.45::double as ok, case when reason is null then {_DETAILS.format('md', 'said')} else '' end as markdown, case when reason is null then ratio else 0.0::double end as fill_ratio, case when reason is null then n else 0 end as n_table_rows from r)"""


def _templates(spark, d):
    k = F.col("o_orderkey")
    kind = F.get(F.array(F.lit("trct"), F.lit("fgts"), F.lit("outro"), F.lit(None).cast("string")), (k % 4).cast("int"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", kind.alias("kind"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("texto "), F.col("o_custkey").cast("string"))).alias("said"))
    made = driver.template_result(F.col("kind"), F.col("said"), F.concat(F.lit("# F"), k.cast("string")), (k % 10).cast("double") / 10, (F.col("o_custkey") % 7).cast("int"))
    return orders.withColumn("t", made)


@query(f"{_TEMPLATES} select o_orderkey, ok, reason, markdown, fill_ratio, n_table_rows from t")
def k2_template_results(spark, d):
    return _templates(spark, d).select("o_orderkey", "t.ok", "t.reason", "t.markdown", "t.fill_ratio", "t.n_table_rows")


@query(f"""{_TEMPLATES}, s as (select *, o_orderkey % 6 = 0 as unasked, case when o_custkey % 3 = 0 then 'visto ' || o_orderkey when o_custkey % 3 = 1 then '' end as seen from t),
 w as (select *, case when ok and not unasked then 'template' when kind in ({_FORMS}) and seen <> '' then 'vlm' when not unasked then 'template' end as source from s)
 select o_orderkey, source, case source when 'template' then ok when 'vlm' then true end as ok, case source when 'template' then markdown when 'vlm' then case when said = '' then seen else {_DETAILS.format('seen', 'said')} end end as markdown,
 case source when 'template' then fill_ratio when 'vlm' then 1.0::double end as fill_ratio, case source when 'template' then n_table_rows when 'vlm' then 0 end as n_table_rows from w""")
def k1_structured_forms(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # every sixth page has no template; a model told something of every third, and nothing readable of another third
    asked = _templates(spark, d).withColumn("t", F.when(k % 6 != 0, F.col("t"))).withColumn("seen", F.when(c % 3 == 0, F.concat(F.lit(" visto "), k.cast("string"))).when(c % 3 == 1, " "))
    out = asked.select("o_orderkey", driver.structured(F.col("t"), F.col("kind"), F.col("seen"), F.col("said")).alias("s"))
    return out.select("o_orderkey", "s.source", "s.ok", "s.markdown", "s.fill_ratio", "s.n_table_rows")


@query("""select c_custkey, case when c_custkey % 4 > 0 then '**Registro**: ' || c_custkey || ' | **Cargo**: Cargo ' || c_mktsegment || ' | **Setor**: S' || c_nationkey || ' | **Conta Corrente**: ' || c_custkey * 7 else '' end as footer,
 '**11 Nome**: ' || c_name || chr(10) || '**18 CPF**: ' || case when c_custkey % 3 > 0 then '1' || c_custkey else '' end || chr(10) || '**49 49**: ' as fields, case when c_custkey % 5 > 0 then 'Foi prestada, gratuitamente, a ' || c_name || chr(10) || 'conforme a Instrução Normativa ' || c_nationkey else '' end as prose from customer""")
def k3_form_footers(spark, d):
    k, s = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    footer = F.when(k % 4 > 0, F.concat(F.lit("fim\nREGISTRO : "), s("c_custkey"), F.lit(" | | Cargo: Cargo "), "c_mktsegment", F.lit(" | Setor: S"), s("c_nationkey"), F.lit(" | Conta Corrente: "), (k * 7).cast("string"), F.lit(" |"))).otherwise(F.concat(F.lit("Registro: "), s("c_custkey")))
    prose = F.when(k % 5 > 0, F.concat(F.lit("x\nFoi prestada, gratuitamente, a "), "c_name", F.lit("\nconforme a Instrução Normativa "), s("c_nationkey"), F.lit("\nfim"))).otherwise("Foi prestada")
    fields = F.create_map(F.lit("11"), F.concat(F.lit(" "), "c_name"), F.lit("18"), F.when(k % 3 > 0, F.concat(F.lit("1"), s("c_custkey"))))
    return table(spark, d, "customer").select("c_custkey", formatters.form_footer(footer).alias("footer"), formatters.numbered_lines(fields, ["11", "18", "49"]).alias("fields"), formatters.homologation_prose(prose).alias("prose"))


@query("""with f as (select c_custkey, case when c_custkey % 2 = 0 then '**Pai**: P' || c_custkey end as pai, case when c_custkey % 3 > 0 then '**Mae**: ' || c_name end as mae, case when c_custkey % 5 > 0 then '**CPF**: ' || c_custkey end as cpf, case when c_custkey % 7 = 0 then '**Cargo**: ' || c_mktsegment end as cargo from customer)
 select c_custkey, concat_ws(chr(10) || chr(10), case when pai is not null or mae is not null then '## Dados Pessoais' || chr(10) || chr(10) || concat_ws(chr(10), pai, mae) end, case when cpf is not null then '## Documentos' || chr(10) || chr(10) || cpf end, case when cargo is not null then '## Dados Funcionais' || chr(10) || chr(10) || cargo end) as sections from f""")
def k4_register_sections(spark, d):
    k = F.col("c_custkey")
    pair = lambda when, key, value: F.when(when, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
    # the mother's name is spelt in two ways, and one key is in no section
    pairs = [pair(k % 7 == 0, "Cargo", F.col("c_mktsegment")), pair(k % 5 > 0, "CPF", k), pair(k % 3 == 1, "Mãe", F.col("c_name")), pair(k % 3 == 2, "Mae", F.col("c_name")), pair(k % 2 == 0, "Pai", F.concat(F.lit("P"), k.cast("string"))), pair(k > 0, "Outro", k)]
    return table(spark, d, "customer").select("c_custkey", formatters.register_sections(F.map_from_entries(F.array_compact(F.array(*pairs)))).alias("sections"))


@query(f"""{with_tables('rubric_lines')}, a as (select l_orderkey, list(amount order by l_linenumber, number, line) as found from rubric_lines group by 1),
 r as (select l_orderkey, case when l_orderkey % 4 = 0 then []::varchar[] else list_concat(found[1:6], [case when l_orderkey % 3 = 0 then '5/30' else '' end], ['', '', '', '', '', '', ''])[1:7] end as cells from a)
 select l_orderkey, len(cells) as n_cells, array_to_string(cells, ';') as cells from r""")
def k5_base_amounts(spark, d):
    k = F.col("l_orderkey")
    said = rubric_lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "number", "line", "amount"))), lambda x: x["amount"]).alias("found"))
    # every fourth slip lacks the heading
    head = F.when(k % 4 == 0, "Total").otherwise("Salário  Base Calc. FGTS  Faixa")
    text = F.concat(F.lit("Recibo\n"), head, F.lit("\n\n"), F.array_join("found", "  "), F.when(k % 3 == 0, "  5/30").otherwise(""), F.lit("\nfim 1,00"))
    cells = formatters.base_amounts(text)
    return said.select("l_orderkey", F.size(cells).cast("long").alias("n_cells"), F.array_join(cells, ";").alias("cells"))
