from pyspark.sql import functions as F

from foliospark.operators import driver, layout, tables
from foliospark.sources import sinks

PAGE = "doc_kind string, forced boolean, residual_text string, fls long, ocr_text string, tables array<string>, ocr_error string, retry_text string, retry_tables array<string>, retry_error string, second_text string, second_tables array<string>, filled struct<ok:boolean,markdown:string,source:string,fill_ratio:double,n_table_rows:int>, caption string, figures struct<text:string,images_described:bigint,has_tables:boolean>"
NAMES = [p.split(" ")[0] for p in PAGE.split(", ")]
LONG = "um texto bastante longo que basta para ser lido por todos nós"


def image(spark, **page):
    row = driver.image_pages(spark.createDataFrame([tuple(page.get(n) for n in NAMES)], PAGE)).collect()
    assert len(row) == 1
    return row[0]


def test_an_engine_that_fails_is_retried(spark):
    got = image(spark, ocr_error="boom", retry_text=LONG)
    assert (got.text, got.ocr_failed, got.reason, got.source) == (LONG, False, None, None)
    got = image(spark, ocr_error="boom", residual_text=" resto ")
    assert (got.text, got.ocr_failed, got.reason) == ("resto", True, "ocr_failed: boom")
    assert image(spark, ocr_error="boom", retry_error="bang").reason == "ocr_failed: bang"
    assert image(spark).reason == "empty_after_ocr"
    assert not image(spark, residual_text="resto").ocr_failed


def test_a_caption_stands_for_a_page_without_text(spark):
    got = image(spark, caption="Um gato.")
    assert (got.text, got.source, got.images_described, got.ocr_failed, got.reason) == ("### Descrição da imagem\nUm gato.", "image_describe", 1, False, None)
    got = image(spark, caption="Um gato.", figures=("### Descrição da imagem 1\nA\n\nB | C", 1, True))
    assert (got.text, got.source, got.images_described, got.has_tables) == ("### Descrição da imagem 1\nA\n\nB | C", "image_describe", 1, True)
    assert image(spark, caption="Um gato.", figures=("", 0, False)).text == ""
    assert image(spark, caption="Um gato.", ocr_text=LONG).text == LONG


def test_forms_take_the_second_pass_and_the_filled_template(spark):
    got = image(spark, doc_kind="ctps", ocr_text="curto", second_text="mais texto")
    assert (got.text, got.source) == ("**Tipo documental**: Carteira de Trabalho (CTPS)\n\nmais texto", "labor_forms")
    assert image(spark, doc_kind="ctps", ocr_text=LONG, second_text="curto").text.endswith(LONG)
    got = image(spark, doc_kind="ctps", ocr_text=LONG, second_tables=["|t|"])
    assert got.has_tables and got.text.endswith("\n\n|t|")
    got = image(spark, doc_kind="fgts", ocr_error="x", filled=(True, " # F ", "template", 0.9, 3), caption="não")
    assert (got.text, got.source, got.has_tables, got.ocr_failed) == ("# F", "template", True, False)
    assert image(spark, forced=True, ocr_text=LONG, filled=(True, "F" * 50, "vlm", 1.0, 0)).source == "vlm"
    assert image(spark, ocr_text=LONG, filled=(True, "F" * 50, "vlm", 1.0, 0)).text == LONG


def test_the_larger_folio_stays(spark):
    assert [image(spark, ocr_text="Fls.: 12 " + LONG, fls=f).fls for f in (None, 3, 12, 40)] == [12, 12, 12, 40]
    assert image(spark, ocr_text=LONG, fls=7).fls == 7


def test_structured_results(spark, one):
    def run(kind, text, markdown, ratio, told):
        t = driver.template_result(F.lit(kind).cast("string"), F.lit(text), F.lit(markdown), F.lit(ratio), F.lit(2))
        return one(lambda x: driver.structured(t, F.lit(kind).cast("string"), F.lit(told).cast("string"), F.lit(text)), "")[0]

    got = run("fgts", "t", "m", 0.5, "modelo")
    assert (got.ok, got.source, got.fill_ratio, got.n_table_rows) == (True, "template", 0.5, 2) and got.markdown.startswith("m\n\n<details>")
    assert tuple(run("fgts", "", "m", 0.5, "modelo"))[:4] == (True, "modelo", "vlm", 1.0)
    assert tuple(run("fgts", "t", "m", 0.4, None))[2:] == ("template", 0.4, 2)
    assert tuple(run("outro", "t", "m", 0.9, "modelo")) == (False, "", "template", 0.0, 0)
    assert run(None, "t", "m", 0.9, None).ok is False


def test_native_pages_and_errors(spark):
    pages = spark.createDataFrame([(1, " a ", None), (2, "a", "ctps"), (3, None, "")], "k int, residual_text string, doc_kind string")
    assert [(r.kind, r.text) for r in driver.native_pages(pages).orderBy("k").collect()] == [(None, "a"), ("ctps", "**Tipo documental**: Carteira de Trabalho (CTPS)\n\na"), (None, "")]
    rows = spark.createDataFrame([(1, "um dois", "r", None, None, None), (2, None, " r ", "boom", None, None), (3, None, None, None, True, "x")], "k int, text string, residual_text string, error string, ocr_failed boolean, reason string")
    assert [(r.text, r.ocr_failed, r.reason, r.word_count, r.char_count) for r in driver.settled(rows).orderBy("k").collect()] == [("um dois", False, None, 2, 7), ("r", True, "boom", 1, 1), ("", True, "x", 0, 0)]


FIGURE = "k int, num int, size int, logo boolean, banner boolean, covered boolean, ocr_text string, tables array<string>, caption string, y int, x int"


def test_hybrid_pages(spark):
    said = "a segunda figura mostra outro documento com conteúdo inteiramente próprio e nada em comum"
    figures = [
        (1, 1, 2999, False, False, False, said, None, None, 400, 0), (1, 2, 3000, True, False, False, said, None, None, 400, 0), (1, 3, 9000, None, None, True, said, None, None, 400, 0),
        (1, 4, 9000, None, None, None, None, None, "Um gato.", 800, 0), (2, 1, 9000, None, None, None, said, ["|t|"], None, None, None), (2, 2, 9000, None, None, None, LONG, None, None, None, None),
        (3, 1, 9000, None, None, None, "x", None, " ", 1, 1),
    ]
    pages = [(1, "linha um\nlinha dois", 842.0), (2, "corpo " + LONG, 842.0), (3, "só", 842.0), (4, None, 842.0)]
    got = {r.k: r for r in driver.hybrid_pages(spark.createDataFrame(pages, "k int, body string, height double"), spark.createDataFrame(figures, FIGURE), "k").collect()}
    assert (got[1].text, got[1].images_described, got[1].has_tables) == ("linha um\nlinha dois\n\n### Descrição da imagem\nUm gato.", 1, False)
    assert (got[2].text, got[2].images_described, got[2].has_tables) == ("corpo " + LONG + "\n\n|t|\n\n" + said, 0, True)
    assert [(got[k].text, got[k].images_described) for k in (3, 4)] == [("só", 0), ("", 0)]


def test_figures_of_an_image_page(spark):
    rows = [(1, 1, 0, None, None, None, None, None, "B", 20, 0), (1, 2, 0, None, None, None, LONG, None, "não", 10, 0), (1, 3, 0, None, None, None, "x", None, "C", 30, 0), (2, 1, 0, None, None, None, None, None, "só uma", 0, 0),
            (3, 1, 0, None, None, None, None, None, "A", 0, 0), (3, 2, 0, None, None, None, None, None, None, 1, 0)]
    got = {r.k: r for r in driver.page_figures(spark.createDataFrame(rows, FIGURE), "k").collect()}
    assert got[1].text == LONG + "\n\n### Descrição da imagem 1\nB\n\n### Descrição da imagem 2\nC" and got[1].images_described == 2
    assert got[3].text == "### Descrição da imagem\nA" and sorted(got) == [1, 3]


def words(spark, pages):
    rows = [(k, n, i, w, x, len(w) * 8) for k, lines in pages.items() for n, line in enumerate(lines) for i, (x, w) in enumerate(line)]
    return spark.createDataFrame(rows, "k int, line_no int, word_no int, word string, x int, w int")


def test_named_tables(spark):
    title = [(0, "Alteragoes"), (100, "de"), (130, "Cargo")]
    head = [(0, "Inicio"), (100, "Descricao"), (300, "Motivo"), (400, "Última"), (460, "Atualização")]
    row = [(0, "01/02/2020"), (100, "Vigia"), (150, "noturno"), (300, "Acordo"), (400, "03/04/2020")]
    sind = [(0, "Alterações"), (90, "de"), (120, "Sindicato")]
    pages = {1: [title, head, row, row, [(900, "longe")], row], 2: [title, [(0, "nada")], row], 3: [title, head, sind, [(0, "Início"), (100, "Descrição")], [(0, "05/06/2021"), (100, "Sinttel")], [(0, "Página"), (60, "2")]]}
    got = [(r.k, r.place, r.title, r.rows) for r in tables.named_tables(words(spark, pages), "k").orderBy("k", "place").collect()]
    cells = ["01/02/2020", "Vigia noturno", "Acordo", "03/04/2020"]
    assert got == [(1, 0, "Alterações de Cargo", [cells, cells]), (3, 0, "Alterações de Sindicato", [["05/06/2021", "Sinttel"]])]


def test_slip_events_by_their_columns(spark):
    head = [(0, "Código"), (100, "Descrigao"), (300, "Referencia"), (400, "Vencimentos"), (520, "Descontos")]
    pages = {
        1: [[(0, "0009"), (50, "ANTES"), (100, "1,00")], head, [(0, "0001"), (100, "SALARIO"), (300, "30,00"), (400, "1.000,00")], [(100, "INSS"), (520, "80,00")], [(100, "sem"), (160, "valor")], [(0, "Mensagens")], [(0, "0002"), (100, "X"), (400, "1,00")]],
        2: [head[1:], [(100, "SALARIO"), (400, "5,00")]],
        3: [[(0, "nada")]],
    }
    got = [tuple(r)[2:] for r in tables.slip_events(words(spark, pages), "k").orderBy("k", "line_no").collect()]
    assert got == [("0009", "ANTES", "", "1,00", ""), ("0001", "SALARIO", "30,00", "1.000,00", ""), ("", "INSS", "", "", "80,00"), ("", "SALARIO", "", "5,00", "")]


def test_tables_from_plain_text(spark):
    text = spark.createDataFrame([(1, "Férias\nDias Abono")], "k int, t string")
    assert tables.named_tables(layout.plain_words(text, "k", "t"), "k", [("F", ["Dias", "Abono"], "^férias")]).collect() == []


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "md")
    sinks.write_markdown(spark.createDataFrame([("a b/c.md", "# um\n\ndois\n"), ("d.md", "três")], "file_name string, markdown string"), folder)
    assert {tuple(r) for r in sinks.read_markdown(spark, folder).collect()} == {("a_b_c.md", "# um\n\ndois\n"), ("d.md", "três")}
    log = str(tmp_path / "log")
    for n in (1, 2):
        sinks.append_audit(spark.createDataFrame([("x/y", f"PAGE_START pagina={n}")], "case_id string, line string"), log)
    assert sorted(tuple(r) for r in sinks.read_audit(spark, log).collect()) == [("x_y", "PAGE_START pagina=1"), ("x_y", "PAGE_START pagina=2")]
