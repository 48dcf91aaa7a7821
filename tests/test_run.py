"""The run as a whole, on a small case file with every branch."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import run

PROSE = "O reclamante afirma que trabalhou para a empresa durante todo o contrato de trabalho e pede o pagamento das verbas rescisórias. " * 6
SIGN = "\nDocumento assinado eletronicamente por FULANO DE TAL - abc1234\nNúmero do processo: 0001234-56.2020.5.01.0001\n"
PAGES = [
    ("case", 1, "Fls.: 1\n" + PROSE + SIGN),  # native
    ("case", 2, "Fls.: 2\n" + PROSE + SIGN),  # hybrid: a figure that was read, one with a caption, a logo
    ("case", 3, "Fls.: 3\n"),  # image, read at the second attempt
    ("case", 4, "Fls.: 4\n"),  # image, not read
    ("case", 5, "Fls.: 5\nresto"),  # an error elsewhere
    ("case", 6, ""),  # image with two figures
    ("other", 1, None),  # nothing at all
]
READ = "Comprovante de transferência bancária no valor de mil reais em favor do reclamante nesta data"
ENGINE = [
    ("case", 3, None, "boom", "Texto lido na segunda tentativa pelo outro motor com palavras bastantes", None), ("case", 4, None, "boom", None, None), ("case", 5, None, None, None, "lost"),
    ("case", 6, "", None, None, None), ("case", 9, "no such page", None, None, None),
]
FIGURES = [("case", 2, 1, 9000, False, READ, None, 100.0), ("case", 2, 2, 9000, False, None, "Uma foto", 700.0), ("case", 2, 3, 9000, True, None, "Um logotipo", 10.0), ("case", 6, 1, 9000, False, None, "Primeira", 50.0), ("case", 6, 2, 9000, False, None, "Segunda", 90.0)]
IMAGES = [("case", 2, 700, 900, 300.0, 300.0, 385.0, 595.0, 842.0)]
INDEX = [("case", "abc1234", "Petição Inicial", "Ato 1"), ("case", "zzz", "Despacho", "Ato 2")]


@pytest.fixture(scope="module")
def made(spark):
    pages = spark.createDataFrame(PAGES, "pdf_id string, page_no int, raw_text string")
    index = spark.createDataFrame(INDEX, "pdf_id string, doc_id string, tipo string, titulo string")
    images = spark.createDataFrame(IMAGES, "pdf_id string, page_no int, width int, height int, y double, display_width double, display_height double, page_width double, page_height double")
    figures = spark.createDataFrame(FIGURES, "pdf_id string, page_no int, num int, size int, logo boolean, ocr_text string, caption string, y double")
    engine = spark.createDataFrame(ENGINE, "pdf_id string, page_no int, ocr_text string, ocr_error string, retry_text string, error string")
    known = run.classified(pages, index, images)
    settled = run.through_files(run.settled_pages(known, figures, engine))
    cases = known.groupBy("pdf_id").agg(F.max("stamp.process_number").alias("case_number")).withColumns({"n_index": F.lit(2).cast("long"), "seconds": F.lit(1.5)})
    return known, settled, run.through_files(run.assembled(settled, cases))


def test_every_page_takes_its_branch(made):
    known, settled, _ = made
    got = {(r.pdf_id, r.page_no): r for r in settled.collect()}
    assert {k: r.page_class for k, r in got.items()} == {("case", 1): "native", ("case", 2): "hybrid", ("case", 3): "image_page", ("case", 4): "image_page", ("case", 5): "image_page", ("case", 6): "image_page", ("other", 1): "image_page"}
    assert got["case", 1].text.startswith("O reclamante") and got["case", 1].fls == 1 and not got["case", 1].ocr_failed
    two = got["case", 2].text
    assert READ in two and "### Descrição da imagem\n" in two and "Uma foto" in two and "logotipo" not in two and got["case", 2].images_described == 1
    assert got["case", 3].text.startswith("Texto lido na segunda") and not got["case", 3].ocr_failed
    assert (got["case", 4].ocr_failed, got["case", 4].reason) == (True, "ocr_failed: boom")
    assert (got["case", 5].ocr_failed, got["case", 5].reason, got["case", 5].text) == (True, "lost", "resto")
    assert got["case", 6].text == "### Descrição da imagem 1\nPrimeira\n\n### Descrição da imagem 2\nSegunda"
    assert (got["other", 1].ocr_failed, got["other", 1].reason) == (True, "empty_after_ocr")
    assert known.count() == len(PAGES)


def test_the_document_as_markdown(made):
    docs = {r.pdf_id: r for r in made[2].collect()}
    text, one = docs["case"].markdown, docs["case"]
    assert text.startswith("# Documento: case\n\n**Número do processo**: `0001234-56.2020.5.01.0001`\n\n## Metadados do Documento\n\n- **Total de páginas**: 6\n- **Modo de processamento**: CPU\n")
    assert "- **Tempo total de processamento**: 1.50s\n- **Documentos no SUMÁRIO PJe**: 2\n" in text
    assert "- **Páginas nativas** (texto digital): 1\n- **Páginas híbridas**: 1\n- **Páginas imagem/OCR**: 4\n- **Falhas de OCR**: 2\n" in text
    order = [text.index(x) for x in ("## Página 1 — Fls.: 1", "## Página 2", "Uma foto", "## Página 4", "> **OCR falhou**: `ocr_failed: boom`", "*Nenhum texto utilizável após falha de OCR.*", "## Página 6", "## Estatísticas")]
    assert order == sorted(order) and text.count("\n\n---\n\n") == 6
    # the signature stays on the last page of its group only
    assert text.count("Documento assinado eletronicamente") == 1 and "Número do processo:" not in text
    assert text.rsplit("\n", 2)[1:] == [f"- **Tokens OpenAI**: {one.openai_tokens:,}", f"- **Tokens Gemini**: {one.gemini_tokens:,}"]
    assert "**Número do processo**" not in docs["other"].markdown


def test_batch_summary(spark, made):
    queue = spark.createDataFrame([("case",), ("other",), ("missing",), ("case",)], "pdf_id string")
    assert tuple(run.batch_summary(queue, made[2]).first()) == (3, 1, 2, 3)
    assert tuple(run.batch_summary(queue, made[2].limit(0)).first()) == (3, 0, 3, 0)


def test_a_batch_done_again_adds_no_row(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"d{k}", n, "x") for n in range(k + 1)], "pdf_id string, page_no int, raw_text string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = "pdf_id string, page_no int, raw_text string"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    count = lambda df: df.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("n"))
    target, failing = str(tmp_path / "out"), {"left": 1}

    def breaks(df):
        out = count(df)
        if failing["left"] and out.where("pdf_id = 'd1'").count():
            failing["left"] -= 1
            out.write.parquet(f"{target}/batch=1")  # a batch that was written, and then lost
            raise ValueError("lost")
        return out

    with pytest.raises(Exception, match="lost"):
        run.run_arriving(stream(), breaks, target, str(tmp_path / "check"))
    for _ in range(2):
        run.run_arriving(stream(), breaks, target, str(tmp_path / "check"))
    assert sorted((r.pdf_id, r.n) for r in run.done(spark, target).collect()) == [("d0", 1), ("d1", 2), ("d2", 3)]
