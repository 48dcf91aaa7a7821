import pytest
from pyspark.sql import functions as F

from foliospark.functions import formatters as fm


def test_keyed_form_takes_each_line_once(one):
    text = "NOME : ANA\nNOME DA MÃE\nMARIA\nCPF:\nDATA ADMISSAO 01/02/2020 \nCTPS -\n\n  77 "
    assert [(r.label, r.value) for r in one(lambda x: fm.keyed_values(x, fm.CD_SD_KEYS), text)[0]] == [("Nome", "ANA"), ("Nome da Mãe", "MARIA"), ("CTPS", "77"), ("Data Admissão", "AO 01/02/2020")]


def test_keyed_form_without_values_is_the_text(one):
    assert one(lambda x: fm.keyed_form(x, fm.CARD_KEYS), "nada aqui", "", None) == ["nada aqui", "", None]


def test_termination_form_from_four_rows(one):
    rows = "01 CNPJ 12.345\n02 Razão Social ACME\n10 PIS 123\n11 Nome Ana\n"
    three = rows[: rows.rindex("11")]
    got = one(fm.termination_form, rows.strip(), three.strip())
    assert got[0].startswith("| Nº | Campo | Valor |\n| --- | --- | --- |\n| 01 | CNPJ | 12.345 |\n| 02 | Razão | Social ACME |\n")
    assert got[1].startswith("| Campo | Valor |\n| --- | --- |\n| CNPJ/CEI | 12.345 |\n| Empregador | ACME |\n| PIS/PASEP | 123 |\n\n<details>")


def test_pay_slip_rows(one):
    text = "Recibo\n0001 SALARIO BASE  1.000,00 \n5001 INSS  80,00 10,00\nValor Líquido 1,00\nvalor liquido 920,00"
    got = one(fm.pay_slip, text, "0001 SALARIO 1,00 2,00")
    assert got[0].split("\n\n")[:2] == ["| Código | Descrição | Vencimentos | Descontos |\n| --- | --- | --- | --- |\n| 0001 | SALARIO BASE |  | 1.000,00 |\n| 5001 | INSS | 80,00 | 10,00 |", "**Valor líquido**: 920,00"]
    assert got[1] == "0001 SALARIO 1,00 2,00"


def test_fund_statement_adds_its_history(one):
    text = "Nome: ANA\n01/02/2020 DEPOSITO 10,00 20,00\n02/03/2020 JAM 1,00 \nfim"
    got = one(fm.fund_statement, text)[0]
    assert got.startswith("| Campo | Valor |\n| --- | --- |\n| Nome | ANA |\n\n<details>")
    # the second row's amount needs white space after it, which stripping takes away
    assert "### Histórico" not in got
    more = one(fm.fund_statement, text.replace("1,00 \n", "1,00 21,00\n"))[0]
    assert more.endswith("### Histórico dos Lançamentos\n\n| Data | Descrição | Valor | Total |\n| --- | --- | --- | --- |\n| 01/02/2020 | DEPOSITO | 10,00 | 20,00 |\n| 02/03/2020 | JAM | 1,00 | 21,00 |")


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [("ctps", " corpo ", "**Tipo documental**: Carteira de Trabalho (CTPS)\n\ncorpo"), ("outro", "corpo", "corpo"), ("ctps", "  ", ""), (None, None, ""),
     ("identidade", "cnh\nNome Ana", "**Tipo documental**: Carteira Nacional de Habilitação (CNH)\n\n| Campo | Valor |\n| --- | --- |\n| Nome | Ana |\n\n<details><summary>Texto OCR completo</summary>\n\ncnh\nNome Ana\n\n</details>")],
)
def test_formatted(one, kind, text, want):
    assert one(lambda x: fm.formatted(x, F.lit(kind).cast("string")), text) == [want]


def test_given_tables_stand_first(one):
    tables = F.array(F.lit(" |a| "), F.lit(""), F.lit("|b|"))
    long = "x" * 81
    assert one(lambda x: fm.formatted(x, F.lit("cct"), tables), "curto", long) == [f"**Tipo documental**: {fm.KIND_LABELS['cct']}\n\n|a|\n\n|b|", f"**Tipo documental**: {fm.KIND_LABELS['cct']}\n\n|a|\n\n|b|\n\n{long}"]


def test_amounts_and_their_totals(one):
    text = "48 Antes 1,00\nDiscriminação das Verbas\n50 Saldo 10,00 | 51 Férias 20,00\n100 Pensão 5,00\nTOTAL BRUTO 30,00 (total)\nTOTAL DEDUÇÕES 5,00\nRegistro: 9\n60 Depois 7,00"
    got = one(fm.amounts, text, None, "nada")
    assert [tuple(r) for r in got[0].earnings] == [("50", "Saldo", "10,00"), ("51", "Férias", "20,00"), ("", "TOTAL BRUTO", "30,00")]
    assert [tuple(r) for r in got[0].deductions] == [("100", "Pensão", "5,00"), ("", "TOTAL DEDUÇÕES", "5,00")]
    assert got[1] == got[2] and got[1].earnings == []
    assert one(lambda x: fm.amount_cells(fm.amounts(x)["earnings"]), text, "nada") == [[["50 Saldo", "10,00", "51 Férias", "20,00", "TOTAL BRUTO", "30,00"]], []]
    assert one(lambda x: fm.amount_cells(fm.amounts(x)["deductions"]), text) == [[["100 Pensão", "5,00", "TOTAL DEDUÇÕES", "5,00", "", ""]]]


def test_footer_and_prose(one):
    assert one(fm.form_footer, "x\nRegistro: 12 | Cargo: Vigia | Setor: A B | Conta Corrente: 9-1", "nada", None) == ["**Registro**: 12 | **Cargo**: Vigia | **Setor**: A B | **Conta Corrente**: 9-1", "", ""]
    assert one(fm.homologation_prose, "a Foi prestada\nassistência conforme Instrução Normativa 15\nfim", "nada") == ["Foi prestada\nassistência conforme Instrução Normativa 15", ""]


def test_fields_and_sections(one):
    fields = F.create_map(F.lit("01"), F.lit(" 1 "), F.lit("Mãe"), F.lit("M"), F.lit("CPF"), F.lit("2"))
    assert one(lambda x: fm.numbered_lines(fields, ["01", "02", "99"]), "") == ["**01 CNPJ/CEI**: 1\n**02 Razão Social / Nome**: \n**99 99**: "]
    assert one(lambda x: fm.register_sections(fields), "") == ["## Dados Pessoais\n\n**Mae**: M\n\n## Documentos\n\n**CPF**: 2"]


def test_slip_events(one):
    text = "ACME 10\nCódigo Descrição Referência Vencimentos\n0001 SALARIO 30,00 1.000,00\n5001 INSS 80,00\nHORAS EXTRAS 10 50,00 5,00\nMensagens\n0009 NADA 1,00"
    assert [tuple(e) for e in one(fm.slip_events, text)[0]] == [("0001", "SALARIO", "30,00", "1.000,00", ""), ("5001", "INSS", "", "80,00", ""), ("", "HORAS EXTRAS", "10", "50,00", "5,00")]
    assert one(fm.slip_events, "", None, "nada") == [[], [], []]


def test_column_events(one):
    text = "x\nRecibo de Pagamento\nDescrição\n0001\nSALARIO 30\nINSS\nVencimentos\n1.000,00\n20,00\n5,00\nfim"
    assert [tuple(e) for e in one(fm.column_events, text)[0]] == [("", "SALARIO", "30", "1.000,00", ""), ("", "INSS", "", "20,00", ""), ("", "", "", "5,00", "")]
    assert one(fm.column_events, "Recibo de Pagamento\nDescrição\nUM\nCBO", "", None) == [[], [], []]


def test_base_amounts(one):
    assert one(fm.base_amounts, "Sal Base Calc FGTS\n1,00 2,00 3/4 5,00", "Base Calc. x\n1,00", "Base Calc FGTS") == [["1,00", "2,00", "5,00", "3/4", "", "", ""], [], []]


def test_column_history(one):
    text = "Histórico dos Lançamentos\n08/04/2026\n01/02/2025\n03/04/2025\nDescrição dos lançamentos\nSALDO ANTERIOR\nDEPOSITO\nJAM\nValor R$\n10,00\n1,00\nTotal R$\n100,00\n110,00\n111,00"
    assert [tuple(r) for r in one(fm.column_history, text)[0]] == [("", "SALDO ANTERIOR", "", "100,00"), ("01/02/2025", "DEPOSITO", "10,00", "110,00"), ("03/04/2025", "JAM", "1,00", "111,00")]
    assert one(fm.column_history, text.replace("SALDO ANTERIOR", "X"), "", None) == [[], [], []]


def test_fund_history(one):
    text = "01/01/2020 ANTES 1,00 2,00\nHistórico dos Lançamentos\nSALDO ANTERIOR 5,00\n02/02/2020 DEP 1,00 6,00\nImprimir\n03/02/2020 DEP 1,00 7,00"
    assert [tuple(r) for r in one(fm.fund_history, text)[0]] == [("", "SALDO ANTERIOR", "", "5,00"), ("02/02/2020", "DEP", "1,00", "6,00")]
    assert [len(x) for x in one(fm.fund_history, "01/01/2020 A 1,00 2,00\nexterno\n01/01/2020 B 1,00 2,00", "nada", None)] == [2, 0, 0]
