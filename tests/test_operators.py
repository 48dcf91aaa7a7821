from foliospark.operators import compare, forms, layout
from foliospark.operators import pages as ops


def test_letterheads_repeat_on_three_pages(spark):
    body = "\n".join(f"linha de corpo numero {k} com texto" for k in range(4))
    page = "Fonseca & Braga Advogados\n" + body + "\nwww.x.example.org"
    df = spark.createDataFrame([("d", k, page) for k in (1, 2, 3)] + [("e", 1, page)], "pdf_id string, page_no int, residual_text string")
    got = {(r.pdf_id, r.page_no): r.residual_text for r in ops.strip_letterheads(df).collect()}
    assert got["d", 1] == body
    assert got["e", 1] == "Fonseca & Braga Advogados\n" + body


def test_short_pages_keep_the_closing(spark):
    text = "a b\nc d\ncorpo do texto aqui\ncorpo\nMaria da Silva Souza\nfim"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, ""), ("d", 3, None)], "pdf_id string, page_no int, residual_text string")
    got = {r.page_no: r.residual_text for r in ops.strip_letterheads(df).collect()}
    assert got == {1: text, 2: "", 3: ""}


def test_keep_signature_on_the_last_page_of_a_group(spark):
    df = spark.createDataFrame([("d", 1, ["A"]), ("d", 2, ["a"]), ("d", 3, []), ("d", 4, ["b", "c"]), ("d", 5, ["c", "b"])], "pdf_id string, page_no int, signature_ids array<string>")
    assert [r.keep_signature for r in ops.keep_signature(df).orderBy("page_no").collect()] == [False, True, False, False, True]


def test_index_priority(spark):
    pages = spark.createDataFrame([("d", 1, ["aaaaaaa", "BBBBBBB"]), ("d", 2, ["aaaaaaa"]), ("d", 3, ["zzzzzzz"])], "pdf_id string, page_no int, signature_ids array<string>")
    index = spark.createDataFrame([("d", "aaaaaaa", "Despacho", "x"), ("d", "bbbbbbb", "Contracheque", "y")], "pdf_id string, doc_id string, tipo string, titulo string")
    assert {r.page_no: r.doc_id for r in ops.index_lookup(pages, index).collect()} == {1: "bbbbbbb", 2: "aaaaaaa", 3: None}


def test_recall_counts_a_multiset(spark):
    ref = spark.createDataFrame([(1, "1,00 1,00 2,00"), (2, "nada"), (3, "5,00")], "k int, t string")
    ext = spark.createDataFrame([(1, "1,00 <details>1,00</details> 3,00")], "k int, t string")
    assert {r.k: round(r.recall, 4) for r in compare.money_recall(ref, ext, "k", "t", "t").collect()} == {1: 0.3333, 2: 1.0, 3: 0.0}


def test_lines_follow_the_words_that_joined(spark):
    rows = [(1, "a", 0, 0, 10, 16), (1, "b", 50, 7, 10, 16), (1, "c", 100, 14, 10, 16), (1, "d", 0, 60, 10, 16)]
    got = layout.visual_lines(spark.createDataFrame(rows, "k int, word string, x int, y int, w int, h int"), "k").orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b c", "d"]


def test_tied_blocks_stay_with_the_paragraph_that_the_first_begins(spark):
    # the first order is tied in y, x and text at two heights, the second at one: the SQL leaves both open, the reference walks once
    rows = [(1, 30, 1, 15, "O1"), (1, 72, 3, 5, "O3"), (1, 72, 3, 11, "O3"), (1, 112, 5, 24, "O5"), (2, 22, 1, 8, "O1"), (2, 61, 3, 24, "F3"), (2, 61, 3, 24, "F3")]
    for blocks in (rows, rows[::-1]):
        got = layout.paragraphs(spark.createDataFrame(blocks, "k int, y int, x int, height int, text string"), "k").collect()
        assert sorted(map(tuple, got)) == [(1, 0, "O1"), (1, 1, "O3 O3"), (1, 2, "O5"), (2, 0, "O1"), (2, 1, "F3 F3")]


def test_colspans(spark):
    cells = spark.createDataFrame([("t", 0, 0, ""), ("t", 0, 1, "x"), ("t", 0, 2, ""), ("t", 0, 3, "y")], "k string, row int, col int, text string")
    assert sorted((r.col, r.text, r.colspan) for r in layout.colspans(cells, "k").collect()) == [(1, "x", 2), (3, "y", 1)]


def test_numbered_fields(spark):
    rows = [
        (1, 0, 0, "01", 0, 20), (1, 0, 1, "CNPJ", 30, 40), (1, 0, 2, "02", 300, 20), (1, 0, 3, "Nome", 330, 40),
        (1, 1, 0, "123", 10, 30), (1, 1, 1, "ANA", 310, 30), (1, 1, 2, "SOUZA", 350, 40),
        (1, 2, 0, "10", 0, 20), (1, 2, 1, "PIS", 30, 30), (1, 2, 2, "456", 80, 20), (1, 3, 0, "50", 0, 20), (1, 3, 1, "Saldo", 30, 30), (1, 3, 2, "9,99", 80, 20),
    ]
    words = spark.createDataFrame(rows, "k int, line_no int, word_no int, word string, x int, w int")
    assert sorted((r.number, r.value) for r in forms.numbered_fields(words, "k").collect()) == [("01", "123"), ("02", "ANA SOUZA"), ("10", "456")]


def test_pay_slip_caps(spark):
    slip = "Recibo de Pagamento\nNome: ANA\nCNPJ: 12.345.678/0001-90\n0001 Salário 1.000,00\n0002 Hora 30,5 10,00\nValor Líquido 1.010,00"
    df = spark.createDataFrame([(1, slip), (2, slip + "\n0003 Extra 5,00"), (3, None)], "k int, t string")
    got = {r.k: (r.n_events, r.fill_ratio, r.ok) for r in forms.pay_slips(df, "k", "t").collect()}
    assert got == {1: (2, 0.35, False), 2: (3, 0.8, True), 3: (0, 0.0, False)}


def test_index_rows_with_wrapped_cells(spark):
    from foliospark.operators import index

    text = "SUMÁRIO antigo\ncapa\nSUMÁRIO\nId.   Data   Documento                              Tipo\n   Documento de\nabc1234  01/02/2020 10:30  Carteira" + " " * 40 + "Identificação\n   segunda linha\nfed4321  03/04/2021 9:05  Ata" + " " * 40 + "Despacho\nFls.: 3"
    got = {r.doc_id: (r.titulo, r.tipo) for r in index.parse_index(spark.createDataFrame([("d", text), ("e", "sem")], "pdf_id string, text string")).collect()}
    assert got == {"abc1234": ("Carteira segunda linha", "Documento de Identificação"), "fed4321": ("Ata", "Despacho")}


def test_reading_order(spark):
    from foliospark.operators import figures

    rows = [("p", "b", 50.0, 10.0, 12.0), ("p", "a", 0.0, 12.0, 12.0), ("p", " ", 0.0, 11.0, 12.0), ("p", "c", 0.0, 60.0, 12.0)]
    got = figures.reading_order(spark.createDataFrame(rows, "k string, text string, x double, y double, height double"), "k").collect()
    assert [r.text for r in got] == ["a b\nc"]


def test_merged_words_keep_the_surer_one(spark):
    from foliospark.operators import figures

    rows = [("p", 0, 1, "a", 0, 0, 10, 10, 0.5), ("p", 1, 1, "A", 1, 0, 10, 10, 0.9), ("p", 1, 2, "b", 50, 0, 10, 10, 0.1), ("p", 1, 3, "weak", 0, 1, 10, 10, 0.2)]
    df = spark.createDataFrame(rows, "k string, source int, word_no int, word string, x int, y int, w int, h int, conf double")
    assert [r.word for r in figures.merge_words(df, "k").orderBy("x").collect()] == ["A", "b"]


def test_figures_between_lines(spark):
    from foliospark.operators import figures

    bodies = spark.createDataFrame([(1, "l1\nl2\nl3\nl4", 842.0), (2, "", 842.0)], "k int, body string, height double")
    captions = spark.createDataFrame([(1, 400.0, 1.0, "FIG"), (1, 1.0, 1.0, "TOP"), (2, 1.0, 1.0, "ONLY")], "k int, y double, x double, caption string")
    assert {r.k: r.body for r in figures.merge_figures(bodies, captions, "k").collect()} == {1: "TOP\n\nl1\nl2\n\nFIG\n\nl3\nl4", 2: "ONLY"}


def test_ruled_tables(spark):
    marks = [(1, a, at) for a in "xy" for at in (0, 3, 100, 200)] + [(2, "x", 0), (2, "x", 100), (2, "x", 200), (2, "y", 0), (2, "y", 9)]
    words = [(1, "b", 60, 10, 20, 10), (1, "a", 10, 10, 20, 10), (1, "c", 110, 110, 20, 10), (1, "fora", 500, 500, 20, 10), (2, "x", 10, 1, 5, 5)]
    got = layout.ruled_tables(spark.createDataFrame(marks, "k int, axis string, at int"), spark.createDataFrame(words, "k int, word string, x int, y int, w int, h int"), "k")
    assert sorted((r.k, r.row, r.col, r.text, r.colspan) for r in got.collect()) == [(1, 0, 0, "a b", 2), (1, 1, 1, "c", 1)]


def test_value_parts():
    assert forms.value_parts("12.345.678/0001-90 ACME LTDA 01/02/2020", 3) == ["12.345.678/0001-90", "ACME LTDA", "01/02/2020"]
    assert forms.value_parts("a  b  c", 2) == ["a", "b c"]
    assert forms.value_parts("x 1,00", 3) == ["x", "1,00", ""]
    assert forms.value_parts("x y", 3) == ["x y"]
    assert forms.value_parts("x y", 1) == ["x y"]


def test_glued_labels_and_values_by_place(spark):
    line = lambda n, *ws: [(1, n, i, w, x, 8 * len(w)) for i, (w, x) in enumerate(ws)]
    rows = [*line(0, ("01CNPJ", 0), ("02Nome", 400)), *line(1, ("12.345.678/0001-90", 900), ("ANA", 1100)), *line(2, ("24", 0), ("Data", 30), ("01/02/2020", 200)), *line(3, ("30", 0), ("31", 40), ("Nada", 80))]
    words = spark.createDataFrame(rows, "k int, line_no int, word_no int, word string, x int, w int")
    assert sorted((r.number, r.value) for r in forms.numbered_fields(words, "k").collect()) == [("01", "12.345.678/0001-90"), ("02", "ANA")]
