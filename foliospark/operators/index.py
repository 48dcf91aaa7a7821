"""The docket's index: lines of its table become rows (doc_id, titulo, tipo, data_assinatura).

Spark labels every line (a row with an id, a line to skip, its indent, whether it reads like a kind of act); only the
walk over labelled lines, in which a wrapped cell belongs to what came before or comes next, is sequential.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import any_of, has
from ..functions.text import flagged, lines, strip, text_of, word_count

TYPE_COLUMN = 60
# fixed values: the row pattern, lines to skip, and words of kinds of acts
ROW = r"^\s*([0-9A-Fa-f]{7})\s+(\d{2}/\d{2}/\d{4}\s+\d{1,2}:\d{2})\s+(.*)$"
SKIPS = (r"^\s*fls\.?\s*:", r"^\s*documento assinado eletronicamente", r"^\s*data da\s*$", r"^\s*assinatura\s*$")
PHRASES = (
    "documento de", "identificação", "declaração de", "hipossuficiência", "carteira de trabalho", "previdência social", "(ctps)", "convenção coletiva", "trabalho (cct)", "trabalho (act)", "ficha de registro", "empregado", "cartão de", "ponto/controle", "frequência",
    "contracheque", "recibo", "de salário", "termo de rescisão", "contrato de trabalho", "(trct)", "comunicação de", "dispensa e seguro", "desemprego (cd/sd)", "acordo coletivo", "solicitação de", "habilitação", "substabelecimento", "com reserva de", "poderes",
)
STARTS = (
    "documento", "declaração", "carteira", "convenção", "ficha", "cartão", "contracheque", "termo", "comunicação", "dispensa", "desemprego", "acordo", "solicitação", "identificação", "empregado", "previdência", "trabalho", "recibo", "frequência", "substabelecimento", "poderes",
)
TRUNCATED = (
    " de", " do", " da", " e", "registro de", "contrato de", "dispensa e", "seguro", "trabalho e", "previdência", "recibo", "documento de", "comunicação de", "declaração de", "carteira de", "convenção coletiva de", "acordo coletivo de", "solicitação de", "cartão de", "ponto/controle de", "com reserva de",
)


def type_phrase(c: Column) -> Column:
    """Whether a line reads like part of a kind of act."""
    low = strip(F.lower(c))
    return has(low, *PHRASES) | ((word_count(low) <= 4) & any_of(low.startswith(s) for s in STARTS))


def index_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Labelled lines after the last heading of the index: pdf_id, line_no, id, date, left, right, indent, phrase, line."""
    t = text_of(F.col(text))
    upper = F.upper(t)
    last = lambda w: F.length(upper) - F.instr(F.reverse(upper), w[::-1]) - len(w) + 2
    start = F.when(upper.contains("SUMÁRIO"), last("SUMÁRIO")).when(upper.contains("SUMARIO"), last("SUMARIO"))
    around_heading = F.split(F.substr(t, start, F.length(t)), flagged(r"^\s*Id\.?\s+.*Tipo\s*$", "im"), 2)
    each = df.where(start.isNotNull()).select("pdf_id", F.posexplode(lines(F.element_at(around_heading, -1))).alias("line_no", "line"))
    line = F.col("line")
    skip = (strip(line) == "") | any_of(line.rlike(flagged(p, "i")) for p in SKIPS)
    rest = F.regexp_extract("line", flagged(ROW), 3)
    at = F.instr(line, rest) - 1
    cut = F.greatest(F.lit(0), F.lit(TYPE_COLUMN) - at)
    by_column = (cut > 0) & (cut < F.length(rest))
    cells = F.split(strip(rest), r"(?U)\s{2,}", -1)
    left = F.when(by_column, strip(F.substr(rest, F.lit(1), cut))).when(F.size(cells) >= 2, F.array_join(F.slice(cells, F.lit(1), F.size(cells) - 1), " ")).otherwise(strip(rest))
    right = F.when(by_column, strip(F.substr(rest, cut + 1, F.length(rest)))).when(F.size(cells) >= 2, F.element_at(cells, -1)).otherwise("")
    is_row = line.rlike(flagged(ROW))
    return each.where(~skip).select(
        "pdf_id", "line_no", F.when(is_row, F.lower(F.regexp_extract("line", flagged(ROW), 1))).alias("id"), F.when(is_row, strip(F.regexp_extract("line", flagged(ROW), 2))).alias("date"), F.when(is_row, left).alias("left"), F.when(is_row, right).alias("right"),
        (F.length(line) - F.length(F.regexp_replace(line, "^ +", ""))).alias("indent"), type_phrase(line).alias("phrase"), strip(line).alias("line"),
    )


def _walk(table: pa.Table) -> pa.Table:
    """One document's labelled lines in order -> index rows; of rows with one id the last counts."""
    rows: dict[str, dict] = {}
    open_row, ahead = None, []
    for x in sorted(table.to_pylist(), key=lambda r: r["line_no"]):
        if x["id"] is not None:
            open_row = {"titulo": [x["left"]], "tipo": [*ahead, x["right"]], "date": x["date"]}
            rows.pop(x["id"], None)
            rows[x["id"]] = open_row
            ahead = []
            continue
        tipo = " ".join(p for p in open_row["tipo"] if p).strip().lower() if open_row else ""
        unfinished = open_row is not None and (not tipo or tipo.endswith(TRUNCATED))
        if unfinished and (x["indent"] >= 40 or x["phrase"]):
            open_row["tipo"].append(x["line"])
        elif open_row is not None and x["indent"] < TYPE_COLUMN and not x["phrase"]:
            open_row["titulo"].append(x["line"])
        else:
            ahead.append(x["line"])
    tidy = lambda parts: " ".join(" ".join(parts).split())
    pdf = table.column("pdf_id")[0].as_py()
    out = [(pdf, k, tidy(r["titulo"]), tidy(r["tipo"]) or tidy(r["titulo"]), r["date"]) for k, r in rows.items()]
    return pa.table({n: pa.array([r[k] for r in out], pa.string()) for k, n in enumerate(("pdf_id", "doc_id", "titulo", "tipo", "data_assinatura"))})


def parse_index(df: DataFrame, text: str = "text") -> DataFrame:
    """(pdf_id, doc_id, titulo, tipo, data_assinatura) from the text of each document's last pages."""

    def walk(table: pa.Table) -> pa.Table:
        return _walk(table)

    return index_lines(df, text).groupBy("pdf_id").applyInArrow(walk, "pdf_id string, doc_id string, titulo string, tipo string, data_assinatura string")
