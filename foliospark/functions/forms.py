"""Column functions for labour forms: misread text, amounts, rows of tables, key and value pairs, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, escape_html, flagged, replace_all, strip, text_of

# fixed values: the form patterns
MONEY = r"-?\d{1,3}(?:\.\d{3})*,\d{2}"
DATE = r"\b\d{2}/\d{2}/\d{4}\b"
SALARY_ROW = r"Sal[aá]rio\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}/\d{2}/\d{4})\s+([\d.]+,\d{2})\s+(.+?)\s+(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2})"
EVENT_ROW = r"^(\d{4})\s+(.+?)\s+(-?[\d.]+,\d{2})\s*(-?[\d.]+,\d{2})?\s*$"
EVENT_REFERENCE_ROW = r"^(\d{4})\s+(.+?)\s+([\d.,]+)\s+(-?[\d.]+,\d{2})\s*(-?[\d.]+,\d{2})?\s*$"
HISTORY_ROW = r"^(?:(\d{2}/\d{2}/\d{4})\s+)?(.+?)\s+(-?[\d.]+,\d{2})\s+(-?[\d.]+,\d{2})\s*$"
RUBRIC = r"(?<!\d)(\d{2,3}(?:\.\d)?)\s+(.+?)\s+(-?[\d.]+,\d{2})\s*$"
NUMBERED_LABEL = r"^\d{1,3}(?:[.,]\d)?\s+[A-Za-zÀ-ú(]"
DETAILS = r"<details\b[^>]*>.*?</details>"
#: Misreadings of scanned forms, in order.
MISREADINGS = (
    (flagged(r"\bFis\.:", "i"), "Fls.:"),
    (flagged(r"\b16\s+CER\b"), "16 CEP"),
    (flagged(r"\bCER\b"), "CEP"),
    (flagged(r"\b130\s+[Ss]al[aá]rio"), "13o Salário"),
    (flagged(r"\b64\.1\s+130\s+[Ss]al[aá]rio"), "64.1 13o Salário"),
    (flagged(r"\b70\s+130\s+[Ss]al[aá]rio"), "70 13o Salário"),
    (flagged(r"8\s+8[ºo°]"), "§ 8º"),
    (flagged(r"81[ºo°]"), "§ 1º"),
    (flagged(r"CIC:"), "C/C:"),
    (flagged(r"nydus\s+ru\b", "i"), "nydus RH"),
    (flagged(r"\$J(\d)"), "SJ$1"),
    (flagged(r"\b0\.00\b"), "0,00"),
    (flagged(r"\b(\d{1,3})\.(\d{3})(\d{2})\b"), "$1.$2,$3"),
)


def corrected(c: Column) -> Column:
    return replace_all(text_of(c), MISREADINGS)


def money_values(c: Column) -> Column:
    """Amounts as written, outside collapsible blocks."""
    return F.regexp_extract_all(F.regexp_replace(text_of(c), flagged(DETAILS, "is"), ""), F.lit(flagged(MONEY)), F.lit(0))


def number_key(c: Column) -> Column:
    """A field number as a number; 0 if it is none."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def number_text(c: Column) -> Column:
    t = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"^(\d+)\.0$", "$1")
    return F.when(t.rlike(r"^\d+$") & (F.length(t) <= 2), F.lpad(t, 2, "0")).otherwise(t)


def groups(c: Column, pattern: str, names: list[str], flags: str = "") -> Column:
    """Named groups of the first match as a struct of strings, or null; a group without a part is empty."""
    p = flagged(pattern, flags)
    return F.when(c.rlike(p), F.struct(*[F.regexp_extract(c, p, k).alias(n) for k, n in enumerate(names, 1)]))


def salary_rows(c: Column) -> Column:
    """Rows of salary changes: reference, start, amount, reason, update."""
    p = F.lit(flagged(SALARY_ROW))
    parts = [F.regexp_extract_all(text_of(c), p, F.lit(k)) for k in range(1, 6)]
    zipped = F.arrays_zip(*[x.alias(n) for x, n in zip(parts, "abcde", strict=True)])
    return F.transform(zipped, lambda z: F.struct(z["a"].alias("reference"), z["b"].alias("start"), z["c"].alias("amount"), strip(z["d"]).alias("reason"), z["e"].alias("updated")))


def event_row(line: Column) -> Column:
    """An event of a pay slip: with a reference column where the line has one."""
    with_reference = groups(line, EVENT_REFERENCE_ROW, ["code", "description", "reference", "amount", "discount"])
    plain = groups(line, EVENT_ROW, ["code", "description", "amount", "discount"])
    without = lambda p: F.when(p.isNotNull(), F.struct(p["code"].alias("code"), p["description"].alias("description"), F.lit("").alias("reference"), p["amount"].alias("amount"), p["discount"].alias("discount")))
    return F.coalesce(with_reference, bound(plain, without))


def history_row(line: Column) -> Column:
    return groups(line, HISTORY_ROW, ["date", "description", "amount", "balance"])


def rubrics(c: Column) -> Column:
    """Numbered amounts of a line whose cells are parted by bars: number, label, value."""
    p = flagged(RUBRIC)

    def one(chunk: Column) -> Column:
        label = F.regexp_replace(F.regexp_replace(F.regexp_extract(chunk, p, 2), r"^[ |\-]+|[ |\-]+$", ""), r"(?U)\s+", " ")
        return F.when(chunk.rlike(p), F.struct(F.regexp_extract(chunk, p, 1).alias("number"), F.regexp_replace(label, r"^[ .]+|[ .]+$", "").alias("label"), F.regexp_extract(chunk, p, 3).alias("value")))

    found = F.transform(F.transform(F.split(text_of(c), r"(?U)\s*\|\s*", -1), strip), one)
    return F.filter(found, lambda r: r.isNotNull() & (number_key(r["number"]) >= 50))


def label_only(c: Column) -> Column:
    s = strip(text_of(c))
    return (s == "") | (s.rlike(flagged(NUMBERED_LABEL)) & ~s.rlike(flagged(MONEY)) & ~s.rlike(flagged(DATE)))


def _quoted(label: str) -> str:
    return "\\Q" + label + "\\E"


def _guarded(*labels: str) -> str:
    return flagged(rf"(?<!\w)(?:{'|'.join(map(_quoted, labels))})(?!\w)", "iu")


def has_label(line: Column, labels: list[str]) -> Column:
    """Whether any of the labels stands on a line; without one, ``label_values`` has nothing to find."""
    return line.rlike(_guarded(*labels))


def label_values(line: Column, labels: list[str]) -> Column:
    """array<struct<label,value>> of one line: hits of labels, those that overlap an earlier one dropped; a value runs to the next hit.

    Hits are sorted by start and end, so of two labels that begin together the shorter one wins.
    """
    t = text_of(line)
    kind = "array<struct<start:int,end:int,label:string>>"

    def hits(label: str) -> Column:
        guard = _guarded(label)
        n = len(label)

        def place(acc: Column, part: Column) -> Column:
            start = acc["pos"] + F.length(part)
            one = F.struct(start.alias("start"), (start + n).alias("end"), F.lit(label).alias("label"))
            return F.struct((start + n).alias("pos"), F.array_append(acc["out"], one).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
        placed = bound(F.split(t, guard, -1), lambda between: F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), start, place, lambda a: a["out"]))
        # a split compiles its pattern for each value, a test once
        return F.when(t.rlike(guard), placed).otherwise(F.array().cast(kind))

    every = F.array_sort(F.concat(*[hits(x) for x in labels]))
    kept = F.aggregate(every, F.array().cast(kind), lambda acc, h: F.when(F.exists(acc, lambda k: (h["start"] < k["end"]) & (h["end"] > k["start"])), acc).otherwise(F.array_append(acc, h)))

    def values(k: Column) -> Column:
        def value(h: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(k, i + 1)["start"], F.length(t))
            raw = F.substr(t, h["end"] + 1, stop - h["end"])
            return F.struct(h["label"].alias("label"), F.regexp_replace(raw, r"^[ :.\-|\t]+|[ :.\-|\t]+$", "").alias("value"))

        return F.filter(F.transform(k, value), lambda p: ~label_only(p["value"]))

    return F.get(F.transform(F.array(kept), values), F.lit(0))


def html_table(headers: list[str], rows: Column) -> Column:
    """HTML of a table from an array of arrays of cells."""
    head = ["<table>", "  <thead>", "    <tr>", *[f"        <th>{h}</th>" for h in headers], "    </tr>", "  </thead>", "  <tbody>"]
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("        <td>"), escape_html(c), F.lit("</td>\n"))), "")
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("    <tr>\n"), cells(r), F.lit("    </tr>\n"))), "")
    return F.concat(F.lit("\n".join(head) + "\n"), body, F.lit("  </tbody>\n</table>"))

# fixed values: labels of the simple forms, and spellings that stand for one key
LABELS = {
    "cnh": ["NOME E SOBRENOME", "Nome", "CPF", "Nº REGISTRO", "Registro", "VALIDADE", "Validade", "CAT HAB", "Categoria", "NASCIMENTO", "Nacionalidade", "FILIAÇÃO", "Filiação", "DOC IDENTIDADE", "1ª HABILITAÇÃO", "DATA EMISSÃO"],
    "cd_sd": ["NOME", "NOME DA MÃE", "CPF", "CTPS", "DATA ADMISS", "DATA DISPENSA", "AVISO PRÉVIO", "PIS"],
    "identidade": ["Nome", "CPF", "RG", "Nascimento", "Filiação", "Naturalidade"],
    "ctps": ["Nome", "CPF", "PIS", "Nascimento", "Filiação", "CTPS"],
}
ALIASES = {
    "Mãe": "Mae", "Cod Município": "Cód Município", "Cod Atividade": "Cód Atividade", "Titulo Eleitor": "Título Eleitor", "Habilitacao": "Habilitação", "Admissao": "Admissão", "Transferencia": "Transferência", "Observacoes": "Observações", "Conjuge": "Cônjuge",
    "Gênero": "Genero", "Raca": "Raça", "Serie": "Série", "Emissao": "Emissão", "Orgao": "Orgão", "Órgão": "Orgão", "Secao": "Seção", "Mes": "Mês", "No Conta FGTS": "Nº Conta FGTS", "Cod. Estab.": "Cód. Estab.", "Data Admissao": "Data Admissão",
    "Data/Cod. Movimentacao": "Data/Cód. Movimentação", "Data Opcao": "Data Opção", "Valor Base para Fins Rescisorios": "Valor Base para Fins Rescisórios", "Saldo": "SALDO",
}


def canonical_label(c: Column) -> Column:
    """The key that a label's spelling stands for."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), c), c)
