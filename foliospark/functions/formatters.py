"""Column functions that write a page of a known kind as Markdown, and the column-wise repairs of slips and statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import flow, forms
from .text import filled_lines, flagged, lines, ocr_fold, ocr_simplify, strip, text_of

# fixed values: titles of kinds, key patterns of the keyed forms, numbers and labels of termination forms, row patterns
KIND_LABELS = {
    "trct": "Termo de Rescisão de Contrato de Trabalho (TRCT)", "cd_sd": "Comunicação de Dispensa e Seguro Desemprego (CD/SD)", "ficha_registro": "Ficha de Registro de Empregado",
    "recibo": "Contracheque / Recibo de Salário", "fgts": "Extrato de FGTS", "cnh": "Carteira Nacional de Habilitação (CNH)", "identidade": "Documento de Identificação",
    "ctps": "Carteira de Trabalho (CTPS)", "cct": "Convenção Coletiva de Trabalho (CCT)", "act": "Acordo Coletivo de Trabalho (ACT)",
}
TRCT_KEYS = [
    (r"CNPJ|CEI", "CNPJ/CEI"), (r"Raz[aã]o\s*Social|Nome", "Empregador"), (r"PIS|PASEP", "PIS/PASEP"), (r"\bCPF\b", "CPF"), (r"Data\s*de\s*Admiss", "Data de Admissão"),
    (r"Data\s*do\s*Afastamento|Data\s*de\s*Afastamento", "Data do Afastamento"), (r"Causa\s*do\s*Afastamento", "Causa do Afastamento"),
]
CD_SD_KEYS = [
    (r"NOME\b", "Nome"), (r"NOME\s*DA\s*M[ÃA]E", "Nome da Mãe"), (r"\bCPF\b", "CPF"), (r"CTPS", "CTPS"), (r"DATA\s*ADMISS", "Data Admissão"),
    (r"DATA\s*DISPENSA", "Data Dispensa"), (r"AVISO\s*PR[ÉE]VIO", "Aviso Prévio"),
]
REGISTER_KEYS = [(r"^Nome\b|Nome\s", "Nome"), (r"Raz[aã]o\s*Social", "Razão Social"), (r"CNPJ", "CNPJ"), (r"\bCPF\b", "CPF"), (r"Admiss", "Admissão"), (r"Cargo", "Cargo"), (r"PIS", "PIS")]
FUND_KEYS = [
    (r"Nome\s*:", "Nome"), (r"PIS", "PIS/PASEP/NIT"), (r"Empresa\s*:", "Empresa"), (r"CNPJ", "CNPJ"), (r"N[oº]?\s*Conta\s*FGTS", "Conta FGTS"), (r"Data\s*Admiss", "Data Admissão"),
    (r"SALDO\s*:", "Saldo"),
]
CARD_KEYS = [
    (r"Nome|NOME", "Nome"), (r"CPF", "CPF"), (r"Registro|REGISTRO", "Registro"), (r"Validade|VALIDADE", "Validade"), (r"Categoria|CATEGORIA", "Categoria"),
    (r"Nascimento|NASCIMENTO|Data.?Nasc", "Data de nascimento"), (r"Filia[cç][aã]o|FILIA", "Filiação"), (r"DOC\.?\s*IDENTIDADE|RG", "Documento de identidade"),
]
FIELD_LABELS = {
    "01": "CNPJ/CEI", "02": "Razão Social / Nome", "03": "Endereço (logradouro, n°, andar, apartamento)", "04": "Bairro", "05": "Município", "06": "UF", "07": "CEP", "08": "CNAE",
    "09": "CNPJ/CEI Tomador/Obra", "10": "PIS/PASEP", "11": "Nome", "12": "Endereço (logradouro, n°, andar, apartamento)", "13": "Bairro", "14": "Município", "15": "UF", "16": "CEP",
    "17": "CTPS (n°, série, UF)", "18": "CPF", "19": "Data de Nascimento", "20": "Nome da Mãe", "21": "Tipo de Contrato", "22": "Causa do Afastamento", "23": "Remuneração Mês Ant.",
    "24": "Data de Admissão", "25": "Data do Aviso Prévio", "26": "Data do Afastamento", "27": "Cód. Afastamento", "28": "Pensão Alim. (%) TRCT", "29": "Pensão Alim (%) FGTS",
    "30": "Categoria do Trabalhador", "31": "Código Sindical", "32": "CNPJ e Nome da Entidade Sindical Laboral",
}
REGISTER_SECTIONS = [
    ("Dados Pessoais", ["Pai", "Mae", "Cônjuge", "Nascimento", "Raça", "Naturalidade", "Nacionalidade", "Instrução", "Estado Civil", "Sexo", "Genero", "Deficiencia"]),
    ("Documentos", ["CTPS", "Série", "Emissão", "UF", "RG", "Orgão", "CPF", "PIS", "Data Cadastro", "Título Eleitor", "Zona", "Seção", "Reservista", "Endereço", "Telefones", "Conta Corrente", "Habilitação", "Categoria", "Vencimento"]),
    ("Dados Funcionais", ["Admissão", "Cargo", "CBO", "Setor", "eSocial", "Periculosidade", "Insalubrid", "Transferência", "Cipa", "Transferido", "Observações"]),
]
TOTALS = [("earnings", "TOTAL BRUTO", r"TOTAL\s+BRUTO\s*[|]?\s*([\d.]+,\d{2})"), ("deductions", "TOTAL DEDUÇÕES", r"TOTAL\s+DEDU[CÇ][OÕ]ES\s*[|]?\s*([\d.]+,\d{2})"), ("deductions", "VALOR LÍQUIDO", r"VALOR\s+L[IÍ]QUIDO\s*[|]?\s*([\d.]+,\d{2})")]
NUMBERED_ROW = r"^\s*(\d{1,3})\s+([A-Za-zÀ-ú0-9][^:\n]{2,60}?)\s+(.+)$"
SLIP_ROW = r"^(\d{3,4})\s+(.+?)\s+([\d.,]+)?\s+([\d.,]+)?\s*$"
SLIP_NET = r"Valor\s+L[ií]quido\s*([\d.,]+)"
FUND_ROW = r"^(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(-?[\d.,]+)\s+(-?[\d.,]+)?\s*$"
WORDY_EVENT = r"^(?:(\d{4})\s+)?([A-Za-zÀ-ú].+?)\s+(?:([\d.,]+)\s+)?(-?[\d.]+,\d{2})\s*(-?[\d.]+,\d{2})?\s*$"
VERBAS_OPEN = r"discrimina[cç][aã]o\s+das\s+verbas|verbas\s+rescis"
VERBAS_CLOSE = r"registro\s*:|digitally\s+signed|documento\s+assinado"
FOOTER = r"Registro\s*:\s*(\S+).*?Cargo\s*:\s*(.+?)\s*\|\s*Setor\s*:\s*(.+?)\s*\|\s*Conta\s*Corrente\s*:\s*(.+)"
HOMOLOGATION_PROSE = r"(Foi prestada[\s\S]+?Instru[cç][aã]o\s+Normativa[^\n]+)"
SLIP_TITLE = "recibo de pagamento"
SLIP_DESCRIPTIONS = r"descri[cçg]\w*[^\n]*\n([\s\S]+?)(?:vencimentos|descontos|nome do|c[oó]digo|mensagens|total\s+venc|cbo\b)"
SLIP_AMOUNTS = r"vencimentos\s*\n((?:\s*-?[\d.]+,\d{2}\s*\n)+)"
SLIP_EMPLOYER = r"verisure|smart alarms|empregador|cnpj"
FUND_TITLE = r"hist[oó]rico\s+dos\s+lan"
FUND_DESCRIPTIONS = r"descri[cçg]\w*\s+dos\s+lan[cç][\w\s]*?\n([\s\S]+?)(?:valor\s*r\$|total\s*r\$|#externo)"
FUND_END = r"valor\s*r\$|total\s*r\$|https?://|documento\s+assinado"
CONSULTED = "08/04/2026"
OPENING = "saldo anterior"
LONG_RESIDUE = 80

_EVENT = "array<struct<code:string,description:string,reference:string,amount:string,discount:string>>"


def _bound(c: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _markdown_table(headers: list[str], rows: Column, names: list[str]) -> Column:
    row = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *[r[n] for n in names]), F.lit(" |"))
    return F.array_join(F.concat(F.array(F.lit("| " + " | ".join(headers) + " |"), F.lit("| " + " | ".join(["---"] * len(headers)) + " |")), F.transform(rows, row)), "\n")


def _details(text: Column) -> Column:
    return F.concat(F.lit("\n\n<details><summary>Texto OCR completo</summary>\n\n"), text, F.lit("\n\n</details>"))


def keyed_values(text: Column, keys: list[tuple[str, str]]) -> Column:
    """array<struct<label,value>>: each key's first line that no earlier key took, with what follows the key on it, or else the
    next line if no key is on that."""
    own = F.transform(filled_lines(text), strip)

    def rests(x: Column) -> Column:
        rest = lambda p: F.when(x.rlike(flagged(p, "i")), F.regexp_replace(F.regexp_replace(x, flagged(f"^.*?(?:{p})", "i"), ""), r"^[ :.\-|\t]+|[ :.\-|\t]+$", ""))
        return F.struct(x.alias("line"), F.array(*[rest(p) for p, _ in keys]).alias("rests"))

    def walk(each: Column) -> Column:
        def step(acc: Column, key: Column) -> Column:
            at = F.get(F.filter(F.sequence(F.lit(0), F.size(each)), lambda i: F.get(F.get(each, i)["rests"], key).isNotNull() & ~F.array_contains(acc["used"], i)), F.lit(0))

            def take(i: Column) -> Column:
                here, below = F.get(F.get(each, i)["rests"], key), F.get(each, i + 1)
                free = below.isNotNull() & ~F.exists(below["rests"], lambda r: r.isNotNull())
                value = F.when(here != "", here).when(free, below["line"])
                taken = F.when(here != "", F.array(i)).otherwise(F.array(i, i + 1))
                found = F.struct(F.get(F.array(*[F.lit(n) for _, n in keys]), key).alias("label"), value.alias("value"))
                return F.when(value.isNotNull(), F.struct(F.concat(acc["used"], taken).alias("used"), F.array_append(acc["found"], found).alias("found"))).otherwise(acc)

            return _bound(at, take)

        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<label:string,value:string>>").alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(keys) - 1)), start, step, lambda a: a["found"])

    return _bound(F.transform(own, rests), walk)


def keyed_form(text: Column, keys: list[tuple[str, str]]) -> Column:
    """A table of fields before the whole text, or the text where no key has a value."""
    return _bound(keyed_values(text, keys), lambda f: F.when(F.size(f) == 0, text).otherwise(F.concat(_markdown_table(["Campo", "Valor"], f, ["label", "value"]), _details(text))))


def _all_groups(c: Column, pattern: str, names: list[str]) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)])


def _row_groups(each: Column, pattern: str, names: list[str]) -> Column:
    return F.filter(F.transform(each, lambda x: forms.groups(x, pattern, names)), lambda r: r.isNotNull())


def termination_form(text: Column) -> Column:
    """Numbered rows as a table from four on, else the keyed form."""
    found = F.transform(_all_groups(text, flagged(NUMBERED_ROW, "m"), ["number", "label", "value"]), lambda r: F.struct(r["number"].alias("number"), strip(r["label"]).alias("label"), strip(r["value"]).alias("value")))
    return _bound(found, lambda r: F.when(F.size(r) < 4, keyed_form(text, TRCT_KEYS)).otherwise(F.concat(_markdown_table(["Nº", "Campo", "Valor"], r, ["number", "label", "value"]), _details(text))))


def pay_slip(text: Column) -> Column:
    """Rows with a code as a table from two on, with the net amount last shown; else the text."""
    rows = _row_groups(F.transform(lines(text), strip), SLIP_ROW, ["code", "description", "earned", "discounted"])
    nets = F.filter(F.transform(lines(text), lambda x: F.regexp_extract(x, flagged(SLIP_NET, "i"), 1)), lambda n: n != "")
    net = F.when(F.size(nets) > 0, F.concat(F.lit("\n\n**Valor líquido**: "), F.element_at(nets, -1))).otherwise("")
    return _bound(rows, lambda r: F.when(F.size(r) < 2, text).otherwise(F.concat(_markdown_table(["Código", "Descrição", "Vencimentos", "Descontos"], F.transform(r, lambda x: x.withField("description", strip(x["description"]))), ["code", "description", "earned", "discounted"]), net, _details(text))))


def fund_statement(text: Column) -> Column:
    """The keyed form, and below it the history from two rows on."""
    rows = _row_groups(F.transform(filled_lines(text), strip), FUND_ROW, ["date", "description", "amount", "balance"])
    history = _bound(rows, lambda r: F.when(F.size(r) < 2, "").otherwise(F.concat(F.lit("\n\n### Histórico dos Lançamentos\n\n"), _markdown_table(["Data", "Descrição", "Valor", "Total"], r, ["date", "description", "amount", "balance"]))))
    return F.concat(keyed_form(text, FUND_KEYS), history)


def formatted(text: Column, kind: Column, tables: Column | None = None) -> Column:
    """Markdown of a page of a kind. Tables that an engine gave stand before the text, which stays if it is long; else the kind's
    own layout is written."""
    def body(t: Column) -> Column:
        k = flow.refined_kind(kind, t)
        titles = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
        title = F.coalesce(F.concat(F.lit("**Tipo documental**: "), F.try_element_at(titles, k), F.lit("\n\n")), F.lit(""))
        shaped = (
            F.when(k == "trct", termination_form(t)).when(k == "cd_sd", keyed_form(t, CD_SD_KEYS)).when(k == "ficha_registro", keyed_form(t, REGISTER_KEYS)).when(k == "recibo", pay_slip(t))
            .when(k == "fgts", fund_statement(t)).when(k.isin("cnh", "identidade"), keyed_form(t, CARD_KEYS)).otherwise(t)
        )
        given = F.coalesce(tables if tables is not None else F.lit(None), F.array().cast("array<string>"))
        whole = F.array_join(F.filter(F.transform(given, lambda x: strip(text_of(x))), lambda x: x != ""), "\n\n")
        beside = F.concat(title, whole, F.when(F.length(t) > LONG_RESIDUE, F.concat(F.lit("\n\n"), t)).otherwise(""))
        return strip(F.when(F.size(given) > 0, beside).when(t == "", "").otherwise(F.concat(title, shaped)))

    return _bound(strip(text_of(text)), body)


# -- termination forms ----------------------------------------------------------------------------------------------------------
def _position(each: Column, rule) -> Column:
    """Index of the first element that fits, or null; elements after it are not tried."""
    step = lambda acc, x: F.struct((acc["i"] + 1).alias("i"), F.when(acc["at"].isNotNull(), acc["at"]).when(rule(x), acc["i"]).alias("at"))
    return F.aggregate(each, F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("at")), step, lambda acc: acc["at"])


def amount_rows(text: Column) -> Column:
    """array<struct<number,label,value>> of the amounts between the heading of the amounts, or a number in the fifties, and the
    signature line."""
    heading = lambda x: x.rlike(flagged(VERBAS_OPEN, "i"))
    opens = lambda x: heading(x) | x.rlike(flagged(r"^\s*5\d(\.\d)?\b"))

    def part(own: Column) -> Column:
        later = F.slice(own, F.coalesce(_position(own, opens), F.size(own)) + 1, F.size(own) + 1)
        close = lambda x: x.rlike(flagged(VERBAS_CLOSE, "i"))
        return _bound(F.filter(later, lambda x: ~heading(x)), lambda body: F.flatten(F.transform(F.slice(body, F.lit(1), F.coalesce(_position(body, close), F.size(body))), forms.rubrics)))

    return _bound(filled_lines(text), part)


def amounts(text: Column) -> Column:
    """struct<earnings, deductions>: amounts below and from number 100, each with the totals that no label has yet."""
    t = text_of(text)

    def with_total(bucket: Column, label: str, pattern: str) -> Column:
        p = flagged(pattern, "i")
        total = F.struct(F.lit("").alias("number"), F.lit(label).alias("label"), F.regexp_extract(t, p, 1).alias("value"))
        return _bound(bucket, lambda b: F.when(F.exists(b, lambda r: F.lower(r["label"]).contains(label.lower())) | ~t.rlike(p), b).otherwise(F.array_append(b, total)))

    def split(rows: Column) -> Column:
        out = {"earnings": F.filter(rows, lambda r: forms.number_key(r["number"]) < 100), "deductions": F.filter(rows, lambda r: forms.number_key(r["number"]) >= 100)}
        for name, label, pattern in TOTALS:
            out[name] = with_total(out[name], label, pattern)
        return F.struct(*[c.alias(n) for n, c in out.items()])

    return _bound(amount_rows(text), split)


def amount_cells(rows: Column) -> Column:
    """Rows of six cells: three names with their amounts each, the last row padded."""
    name = lambda r: strip(F.concat_ws(" ", F.nullif(r["number"], F.lit("")), r["label"]))
    flat = F.flatten(F.transform(rows, lambda r: F.array(name(r), r["value"])))
    padded = F.concat(flat, F.array_repeat(F.lit(""), (-F.size(flat)) % 6 + F.when(F.size(flat) % 6 == 0, 0).otherwise(6)))
    starts = F.when(F.size(flat) > 0, F.sequence(F.lit(1), F.size(flat), F.lit(6))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(padded, i, 6))


def numbered_lines(fields: Column, numbers: list[str]) -> Column:
    """One Markdown line a field number, under its fixed label."""
    return F.array_join(F.array(*[F.concat(F.lit(f"**{n} {FIELD_LABELS.get(n, n)}**: "), strip(text_of(F.try_element_at(fields, F.lit(n))))) for n in numbers]), "\n")


def form_footer(text: Column) -> Column:
    """Register, post, sector and account of a termination form's last line, or ''."""
    p, names = flagged(FOOTER, "is"), ("Registro", "Cargo", "Setor", "Conta Corrente")
    part = lambda k: F.regexp_replace(F.regexp_extract(text, p, k), r"^[ |]+|[ |]+$", "")
    return F.when(text_of(text).rlike(p), F.concat_ws(" | ", *[F.concat(F.lit(f"**{n}**: "), part(k)) for k, n in enumerate(names, 1)])).otherwise("")


def homologation_prose(text: Column) -> Column:
    return strip(F.regexp_extract(text_of(text), flagged(HOMOLOGATION_PROSE, "i"), 1))


def register_sections(fields: Column) -> Column:
    """The fields of an employee register under their headings, in fixed order; empty sections are left out."""
    known = F.coalesce(fields, F.create_map().cast("map<string,string>"))
    spelt = lambda key: [key] + [a for a, b in forms.ALIASES.items() if b == key]

    def section(known: Column, title: str, keys: list[str]) -> Column:
        each = [F.concat(F.lit(f"**{k}**: "), F.try_element_at(known, flow.first_present(known, spelt(k)))) for k in keys]
        return _bound(F.array_compact(F.array(*each)), lambda e: F.when(F.size(e) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(e, "\n"))))

    return _bound(known, lambda known: F.concat_ws("\n\n", *[section(known, t, k) for t, k in REGISTER_SECTIONS]))


# -- pay slips and fund statements --------------------------------------------------------------------------------------------
def _event(code, description, reference, amount, discount) -> Column:
    return F.struct(code.alias("code"), description.alias("description"), reference.alias("reference"), amount.alias("amount"), discount.alias("discount"))


def _wordy_event(line: Column) -> Column:
    g = forms.groups(line, WORDY_EVENT, ["code", "description", "reference", "amount", "discount"])
    return _bound(g, lambda g: g.withField("description", strip(g["description"])))


def event_heading(line: Column, low: Column | None = None) -> Column:
    """Whether a line heads the events of a pay slip; ``low`` is the folded line where that is known."""
    if low is None:
        return _bound(ocr_fold(line), lambda low: event_heading(line, low))
    return (low.contains("descricao") & low.rlike("vencimento|referencia|desconto")) | line.rlike(flagged(r"c[oó]digo\s+descri", "i"))


def slip_events(text: Column) -> Column:
    """Events between their heading, or the first line that reads like one, and the messages."""
    def part(own: Column) -> Column:
        first = _position(own, lambda x: x["heading"] | x["line"].rlike(r"(?U)^\d{4}\b") | x["line"].rlike(flagged(WORDY_EVENT)))
        return _bound(F.filter(F.slice(own, F.coalesce(first, F.size(own)) + 1, F.size(own) + 1), lambda x: ~x["heading"]), events)

    def events(body: Column) -> Column:
        read = F.slice(body, F.lit(1), F.coalesce(_position(body, lambda x: x["last"]), F.size(body)))
        return F.filter(F.transform(read, lambda x: F.coalesce(forms.event_row(x["line"]), _wordy_event(x["line"]))), lambda e: e.isNotNull())

    def told(x: Column, low: Column) -> Column:
        return F.struct(x.alias("line"), event_heading(x, low).alias("heading"), low.contains("mensagens").alias("last"))

    return _bound(F.transform(F.transform(filled_lines(text), strip), lambda x: _bound(ocr_fold(x), lambda low: told(x, low))), part)


def column_events(text: Column) -> Column:
    """Events of slips whose descriptions and amounts were read as two columns, put side by side by position."""
    own, money = flagged(SLIP_DESCRIPTIONS, "i"), flagged(forms.MONEY)

    def slip(part: Column) -> Column:
        employer = lambda x: x.rlike(flagged(SLIP_EMPLOYER, "i")) & ~x.rlike(r"(?U)^\d{4}$")
        before = _bound(F.transform(filled_lines(F.regexp_extract(part, own, 1)), strip), lambda said: F.slice(said, F.lit(1), F.coalesce(_position(said, employer), F.size(said))))
        names = F.filter(before, lambda x: ~x.rlike(flagged(f"^(?:{forms.MONEY})$")) & ~x.rlike(r"(?U)^\d{4}$"))
        values = F.regexp_extract_all(F.regexp_extract(part, flagged(SLIP_AMOUNTS, "i"), 1), F.lit(money), F.lit(0))

        def row(p: Column) -> Column:
            name, tail = text_of(p["name"]), r"(?U)^(.+?)\s+([\d.,]+)$"
            last = F.regexp_extract(name, tail, 2)
            parted = (last != "") & ~last.rlike(flagged(f"^(?:{forms.MONEY})$"))  # group 2 is never empty in a match
            return _bound(parted, lambda parted: _event(F.lit(""), F.when(parted, strip(F.regexp_extract(name, tail, 1))).otherwise(name), F.when(parted, last).otherwise(""), text_of(p["value"]), F.lit("")))

        return _bound(F.arrays_zip(names.alias("name"), values.alias("value")), lambda z: F.when(F.size(z) < 2, F.array().cast(_EVENT)).otherwise(F.transform(z, row)))

    parts = F.split(text_of(text), flagged(SLIP_TITLE, "i"), -1)
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(parts)), slip))


def base_amounts(text: Column, width: int = 7) -> Column:
    """Cells of the line below the heading of the bases: six amounts at most and a fraction, padded; empty if there is no heading."""
    def part(own: Column) -> Column:
        below = text_of(F.get(own, _position(own, lambda x: F.lower(x).contains("base calc") & F.lower(x).contains("fgts")) + 1))
        found = F.regexp_extract_all(below, F.lit(flagged(forms.MONEY)), F.lit(0))
        row = F.concat(F.slice(found, 1, 6), F.array(F.regexp_extract(below, r"(?U)\b\d+/\d+\b", 0)), F.array_repeat(F.lit(""), width))
        return F.when(F.size(found) > 0, F.slice(row, 1, width)).otherwise(F.array().cast("array<string>"))

    return _bound(filled_lines(text), part)


def column_history(text: Column) -> Column:
    """array<struct<date,description,amount,balance>> of a statement whose columns were read one after the other. Balances are the
    last amounts of the page, one a description, and amounts stand before them; the opening balance has neither date nor amount."""
    t = text_of(text)
    # the day the statements were drawn on is no movement
    dates = F.filter(F.regexp_extract_all(t, F.lit(flagged(forms.DATE)), F.lit(0)), lambda d: (d != CONSULTED) & d.rlike(r"(?U)/202[0-9]$"))
    money = F.regexp_extract_all(t, F.lit(flagged(forms.MONEY)), F.lit(0))
    said = F.transform(filled_lines(F.regexp_extract(t, flagged(FUND_DESCRIPTIONS, "i"), 1)), strip)
    whole = lambda p: flagged(f"^(?:{p})$")
    bare = F.filter(said, lambda x: ~x.rlike(whole(forms.DATE)) & ~x.rlike(whole(forms.MONEY)))

    def rows(s: Column) -> Column:
        names, m, days = s["names"], s["money"], s["days"]
        n, total = F.size(names), F.size(m)
        balances = F.when(total >= n, F.slice(m, total - n + 1, n)).otherwise(m)
        # the opening balance's amount is missing, so the amounts are one fewer and end level with the balances
        fewer = F.when(total >= 2 * n - 1, F.slice(m, F.greatest(total - 2 * n + 2, F.lit(1)), n - 1)).otherwise(F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), n - 1)))
        level = F.concat(F.array_repeat(F.lit(""), n - F.size(fewer)), fewer)
        opening = lambda x: F.lower(x).contains(OPENING)

        def row(x: Column, i: Column, at: Column) -> Column:
            dated = i - F.size(F.filter(at["openings"], lambda k: k < i))
            return F.struct(F.when(F.array_contains(at["openings"], i), "").otherwise(text_of(F.get(days, dated))).alias("date"), x.alias("description"), text_of(F.get(at["level"], i)).alias("amount"), text_of(F.get(at["balances"], i)).alias("balance"))

        openings = F.filter(F.transform(names, lambda x, i: F.when(opening(x), i)), lambda i: i.isNotNull())
        return _bound(F.struct(level.alias("level"), balances.alias("balances"), openings.alias("openings")), lambda at: F.transform(names, lambda x, i: row(x, i, at)))

    def read(b: Column) -> Column:
        stop = F.coalesce(_position(b, lambda x: x.rlike(flagged(FUND_END, "i"))), F.size(b))
        names = F.transform(F.slice(b, F.lit(1), stop), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
        return F.struct(names.alias("names"), money.alias("money"), dates.alias("days"))

    none = F.array().cast("array<struct<date:string,description:string,amount:string,balance:string>>")
    shown = lambda s: F.upper(F.array_join(s["names"], " ")).contains(OPENING.upper()) & ocr_simplify(t).rlike(flagged(FUND_TITLE))
    return _bound(_bound(bare, read), lambda s: F.when(shown(s), rows(s)).otherwise(none))


FUND_OPEN = r"hist[oó]rico\s+dos\s+lan[cç]amentos|descri[cç][aã]o\s+dos\s+lan[cç]"  # fixed values
FUND_CLOSE = r"externo|confidencial|imprimir|documento\s+assinado"


def fund_history(text: Column) -> Column:
    """array<struct<date,description,amount,balance>> of the lines between the history's heading and the closing marks; with fewer
    than two there, those before the heading if they are two or more."""
    heads, closes = (lambda p: lambda x: F.lower(x).rlike(flagged(p)))(FUND_OPEN), (lambda p: lambda x: F.lower(x).rlike(flagged(p)))(FUND_CLOSE)

    def row(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(flagged(forms.MONEY)), F.lit(0))
        balance = F.struct(F.lit("").alias("date"), F.lit(OPENING.upper()).alias("description"), F.lit("").alias("amount"), text_of(F.element_at(F.concat(F.array(F.lit("")), found), -1)).alias("balance"))
        plain = forms.history_row(x)
        return F.coalesce(plain.withField("description", strip(plain["description"])), F.when(F.lower(x).contains(OPENING), balance))

    read = lambda own: F.filter(F.transform(F.filter(own, lambda x: ~heads(x) & ~closes(x)), row), lambda r: r.isNotNull())

    def part(own: Column) -> Column:
        at = F.coalesce(_position(own, heads), F.size(own))
        later = F.slice(own, at + 1, F.size(own) + 1)
        inside = F.slice(later, F.lit(1), F.coalesce(_position(later, lambda x: closes(x) & ~heads(x)), F.size(later)))
        both = F.struct(read(inside).alias("inside"), read(F.slice(own, F.lit(1), at)).alias("before"))
        return _bound(both, lambda b: F.when((F.size(b["inside"]) < 2) & (F.size(b["before"]) >= 2), b["before"]).otherwise(b["inside"]))

    return _bound(F.transform(filled_lines(text), strip), part)
