from pyspark.sql import functions as F

from foliospark.functions import banners, forms, pages, stamps, tokens
from foliospark.functions import text as tx


def test_white_space_and_lines(one):
    assert one(tx.strip, "  a b\n", "", None) == ["a b", "", None]
    assert one(tx.lines, "a\nb\n", "", "a\n\nb") == [["a", "b"], [], ["a", "", "b"]]
    assert one(tx.word_count, " a  b ", "", None) == [2, 0, 0]


def test_file_names(one):
    assert one(tx.safe_name, " a/b c ", "", None, "x" * 200) == ["a_b_c", "documento", "documento", "x" * 180]


def test_stamps_go_in_order(one):
    page = "Fls.: 12\nCorpo do texto\nDocumento assinado eletronicamente por FULANA - ab12cd3\nhttps://pje.trt1.jus.br/x\nNúmero do documento: 99\nwww.x.example.org\n"
    assert one(stamps.residue, page, None, "") == ["Corpo do texto", "", ""]
    s = one(stamps.stamp, page)[0]
    assert (s.fls, s.signature_ids, s.document_number, s.process_number) == (12, ["ab12cd3"], "99", None)
    assert s.raw_stamp.split("\n")[0] == "Fls.: 12"


def test_stacked_folios(one):
    assert one(stamps.folios, "Fls.: 2107", "Fls.: 10Fls.: 115", "Fls.: 4100", "Fls.: 0") == [[2, 107], [10, 115], [4, 100], []]
    assert one(stamps.process_folio, "Fls.: 2 107", "nada") == [107, None]


def test_old_stamps_have_ids_at_the_end(one):
    old = "Assinado eletronicamente por: NOME - Juntado em: 19/07/2022 15:35:07 - f744e07"
    assert one(stamps.signature_ids, old) == [[]]
    assert one(stamps.stamp_ids, old) == [["f744e07"]]


def test_clean_body_keeps_signatures(spark):
    df = spark.createDataFrame([("Fls.: 1\nBody\nDocumento assinado eletronicamente por X - abcdefg",), ("",)], "t string")
    none = F.array().cast("array<string>")
    got = [r.b for r in df.select(stamps.clean_body(F.col("t"), F.lit(True), none).alias("b")).collect()]
    assert got == ["Body\n\nDocumento assinado eletronicamente por X - abcdefg", ""]


def test_contacts_and_prose(one):
    prose = "O advogado inscrito na OAB/RJ 12345 com endereço na rua de mesmo nome vem por meio desta requerer o que segue"
    assert one(banners.contact, "www.x.example.org", "(21) 98765-4321", "OAB/RJ 12345", prose, "CPF 053.110.081-21", "05311008121", "60008841-5") == [True, True, True, False, False, False, False]
    assert one(banners.person_name, "Maria da Silva Souza", "Fonseca & Braga Advogados", "maria silva") == [True, False, False]
    assert one(banners.banner, "Fonseca & Braga Advogados", "Maria da Silva Souza", "continua a linha", "curto") == [True, False, False, False]


def test_contacts_part_words_as_told(one):
    lines = ("ALÑCIÓNRAES!! QUE!! CI!!", "Avérla no.", "Al mente.", "Rua das Flores, 12", "ñoab 12", "Alameda", "ñ20000-123", "OAB 12 dojuizñ", "OAB 12 ñjuiz")
    assert one(banners.contact, *lines) == [False, False, True, True, False, True, False, True, True]
    assert one(lambda c: banners.contact(c, tx.flagged_ascii), *lines) == [True, True, True, True, True, True, True, True, False]


def test_preserved_acts(one):
    assert one(pages.preserved, "Intimação", "DESPACHO (cópia)", "Sentença de mérito", "Petição", "Acórdão", None) == [True, True, True, False, False, False]


def test_kinds(one):
    assert one(pages.kind_of_text, "CONVENÇÃO COLETIVA", "o TRCT anexo", "exato", "extrato do FGTS", None) == ["cct", "trct", None, "fgts", None]


def test_usable_text(one):
    good = "palavra " * 60
    assert one(pages.usable, good, "curto", "#### " * 100) == [True, False, False]
    assert one(pages.overlay_only, "Date: 1\n" * 60, good) == [True, False]


def test_misreadings(one):
    assert one(forms.corrected, "4.70540", "130 Salário", "CER $J5 0.00") == ["4.705,40", "13o Salário", "CEP SJ5 0,00"]


def test_rubrics_need_fifty(one):
    got = one(forms.rubrics, "07 Antes 1,00 | 50 Saldo de salário 1.234,56 | 115 Desconto -9,99")[0]
    assert [(r.number, r.label, r.value) for r in got] == [("50", "Saldo de salário", "1.234,56"), ("115", "Desconto", "-9,99")]


def test_label_values_shorter_label_wins(one):
    rule = lambda c: forms.label_values(c, ["Nome", "Nome do Funcionário", "CPF"])
    got = one(rule, "Nome do Funcionário: Ana CPF: 1", "nomeada", None)
    assert [(p.label, p.value) for p in got[0]] == [("Nome", "do Funcionário: Ana"), ("CPF", "1")]
    assert got[1:] == [[], []]


def test_tokens(one):
    assert one(lambda c: tokens.heuristic(c, "openai"), "a b c", "", None) == [4, 0, 0]
    assert one(lambda c: tokens.over_limit(c), 800_000, 800_001, kind="long") == [False, True]
    log = "Total estimado (documentos selecionados / arquivo sanitizado): openai=1 gemini=2\n" * 1 + "total estimado (documentos selecionados / arquivo sanitizado): openai=3 gemini=4"
    assert one(lambda c: tokens.last_estimate(c, "gemini"), log, "x") == [4, None]
