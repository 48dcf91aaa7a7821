"""Engine tables over the synthetic data: a docket of pages, its index, images, form lines, logs.

Everything is worked out with functions that DuckDB has too, so the same rows can be made there; ``SQL`` has that text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of a document, and images of a page.
PAGES, IMAGES = 64, 20
# invented values
TIPOS = ("Petição Inicial", "Intimação", "Despacho (cópia)", "Ficha de Registro de Empregado", "Contracheque", "Documento Diverso", "Convenção Coletiva", "Decisão")
BANNERS = ("Fonseca & Braga Advogados", "E-mail: contato@fonseca.example.org", "www.fonseca.example.org")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: ``PAGES`` texts in order of id are a document; every third page starts a new act. Ids are counted from 0, so
    numbering takes no shuffle, and no document grows with the data."""
    pdf, page = F.concat(F.lit("case-"), F.floor(F.col("doc_id") / PAGES).cast("string")), (F.col("doc_id") % PAGES + 1).cast("int")
    docs = table(spark, sf_dir, "documents").select(pdf.alias("pdf_id"), "doc_id", "text", page.alias("page_no"))
    docs = docs.withColumn("act", F.floor((F.col("page_no") - 1) / 3).cast("int"))
    docs = docs.withColumn("sig", F.substr(F.md5(F.concat_ws(":", "pdf_id", F.col("act").cast("string"))), F.lit(1), F.lit(7)))
    nl, n = F.lit("\n"), F.col("page_no")
    top = F.concat(F.lit("Fls.: "), n.cast("string"), nl, F.when(n % 4 == 0, F.lit(BANNERS[0] + "\n" + BANNERS[1] + "\n")).otherwise(F.lit("")))
    end = F.concat(
        nl, F.when(n % 5 == 0, F.lit("Número do processo: 0001234-56.2020.5.01.0001\nhttps://pje.trt1.jus.br/valida;\n")).otherwise(F.lit("")),
        F.when(n % 4 == 0, F.lit(BANNERS[2] + "\n")).otherwise(F.lit("")), F.lit("Documento assinado eletronicamente por FULANO DE TAL - "), F.col("sig"), nl,
    )
    return docs.withColumn("raw_text", F.concat(top, F.col("text"), end)).withColumn("residual_text", F.concat(F.when(n % 4 == 0, F.lit(BANNERS[0] + "\n" + BANNERS[1] + "\n")).otherwise(F.lit("")), F.col("text"), F.when(n % 4 == 0, F.lit("\n" + BANNERS[2])).otherwise(F.lit(""))))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of the docket; every fifth act is missing."""
    acts = docket(spark, sf_dir).select("pdf_id", "act", F.col("sig").alias("doc_id")).distinct().where("act % 5 <> 4")
    return acts.select("pdf_id", "doc_id", F.get(F.array(*[F.lit(t) for t in TIPOS]), F.col("act") % 8).alias("tipo"), F.concat(F.lit("Ato "), F.col("act").cast("string")).alias("titulo"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages, with sizes from the keys of parts; every fifth has no place on its page."""
    k = F.col("p_partkey")
    placed = lambda c: F.when(k % 5 != 0, c.cast("double"))
    return table(spark, sf_dir, "part").select(
        F.floor(k / IMAGES).alias("page_no"), k.alias("num"), (F.lit(50) + k * 37 % 3000).cast("int").alias("width"), (F.lit(30) + k * 53 % 3600).cast("int").alias("height"),
        placed(k * 11 % 842).alias("y"), placed(F.lit(20) + k * 7 % 560).alias("display_width"), placed(F.lit(10) + k * 13 % 400).alias("display_height"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"),
    )


def rubric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One amount line for each order line, in whole cents: number, label and amount."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 100_000
    amount = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    number = (F.lit(50) + F.col("l_suppkey") % 80).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number.alias("number"), amount.alias("amount"), F.concat(number, F.lit(" Verba "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" "), amount).alias("line"))


_RESIDUE_PARTS = f"""case when page_no % 4 = 0 then '{BANNERS[0]}' || chr(10) || '{BANNERS[1]}' || chr(10) else '' end || text || case when page_no % 4 = 0 then chr(10) || '{BANNERS[2]}' else '' end"""
#: The same tables in DuckDB's SQL, as common table expressions.
SQL = {
    "docket": f"""d0 as (select 'case-' || (doc_id // {PAGES}) as pdf_id, doc_id, text, doc_id % {PAGES} + 1 as page_no from documents),
 d1 as (select *, cast((page_no - 1) // 3 as int) as act from d0),
 d2 as (select *, substr(md5(pdf_id || ':' || act), 1, 7) as sig from d1),
 docket as (select *, 'Fls.: ' || page_no || chr(10) || case when page_no % 4 = 0 then '{BANNERS[0]}' || chr(10) || '{BANNERS[1]}' || chr(10) else '' end || text || chr(10)
   || case when page_no % 5 = 0 then 'Número do processo: 0001234-56.2020.5.01.0001' || chr(10) || 'https://pje.trt1.jus.br/valida;' || chr(10) else '' end
   || case when page_no % 4 = 0 then '{BANNERS[2]}' || chr(10) else '' end || 'Documento assinado eletronicamente por FULANO DE TAL - ' || sig || chr(10) as raw_text,
   {_RESIDUE_PARTS} as residual_text from d2)""",
    "doc_index": "doc_index as (select distinct pdf_id, sig as doc_id, [" + ", ".join(f"'{t}'" for t in TIPOS) + "][act % 8 + 1] as tipo, 'Ato ' || act as titulo from docket where act % 5 <> 4)",
    "page_images": f"""page_images as (select p_partkey // {IMAGES} as page_no, p_partkey as num, cast(50 + p_partkey * 37 % 3000 as int) as width, cast(30 + p_partkey * 53 % 3600 as int) as height,
   case when p_partkey % 5 <> 0 then cast(p_partkey * 11 % 842 as double) end as y, case when p_partkey % 5 <> 0 then cast(20 + p_partkey * 7 % 560 as double) end as display_width,
   case when p_partkey % 5 <> 0 then cast(10 + p_partkey * 13 % 400 as double) end as display_height, 595.0::double as page_width, 842.0::double as page_height from part)""",
    "rubric_lines": """r0 as (select *, cast(round(l_extendedprice * 100) as bigint) % 100000 as cents, cast(50 + l_suppkey % 80 as varchar) as number from lineitem),
 r1 as (select *, cast(cents // 100 as varchar) || ',' || lpad(cast(cents % 100 as varchar), 2, '0') as amount from r0),
 rubric_lines as (select l_orderkey, l_linenumber, number, amount, number || ' Verba ' || l_returnflag || l_linestatus || ' ' || amount as line from r1)""",
}


def with_tables(*names: str) -> str:
    return "with " + ",\n ".join(SQL[n] for n in names)
