"""Tables without ruled lines: headings on a line of words cut the lines below into columns."""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms
from ..functions.formatters import WORDY_EVENT
from ..functions.text import ACCENTED, PLAIN, collapse, flagged, ocr_fold, ocr_simplify, strip
from .walks import walked

# fixed values: titles, headings and opening patterns of an employee register's tables; marks of a page's end; headings of slips
REGISTER_TABLES = [
    ("Alterações de Salários", ["Descrição", "Referencia", "Vigência", "Valor", "Motivo", "Última Atualização"], r"altera[cçg][oõa]es\s+de\s+sal"),
    ("Alterações de Cargo", ["Início", "Descrição", "Motivo", "Última Atualização"], r"altera[cçg][oõa]es\s+de\s+cargo"),
    ("Alterações de Sindicato", ["Início", "Descrição"], r"altera[cçg][oõa]es\s+de\s+sindicato"),
    ("Alterações de Local de Trabalho", ["Início", "Local"], r"altera[cçg][oõa]es\s+de\s+local"),
    ("Férias", ["Período Aquisitivo", "Período de Gozo", "Dias", "Abono", "Última Atualização"], r"^f[eé]rias\b"),
]
PAGE_END = r"p[aá]gina\s+\d|nydus|documento\s+assinado"
SLIP_HEADINGS = [["Código", "Descrição", "Referência", "Vencimentos", "Descontos"], ["Descrição", "Referência", "Vencimentos", "Descontos"]]
MARGIN, LAST_REACH, LEAST_REACH = 8, 40, 10

_FOLD = str.maketrans(ACCENTED, PLAIN)


class Word(NamedTuple):
    line_no: int
    word_no: int
    word: str
    x: float
    w: float
    bare: str
    fold: str
    simple: str


def _bare(token: str) -> str:
    return re.sub(r"\W", "", token).lower()


def _like(seen: str, wanted: str) -> bool:
    """Whether two folded words are one, or one of them of four letters or more begins like the other."""
    return seen == wanted or (len(seen) >= 4 and (seen.startswith(wanted[:4]) or wanted.startswith(seen[:4])))


def heading_bands(line: list[Word], headings: list[str]) -> list[tuple[float, float]] | None:
    """Left and right of each heading's column, or null unless all headings stand on the line in order. A column ends where the
    next heading begins. Words as they are go before words that only look alike."""
    spans, at = [], 0
    for heading in headings:
        exact = [_bare(t) for t in heading.split()]
        alike = [t.translate(_FOLD) for t in exact]
        places = range(at, len(line) - len(exact) + 1)
        same = (k for k in places if [w.bare for w in line[k : k + len(exact)]] == exact)
        near = (k for k in places if all(_like(w.fold, t) for w, t in zip(line[k:], alike, strict=False)))
        k = next(same, None)
        k = next(near, None) if k is None else k
        if k is None:
            return None
        at = k + len(exact)
        spans.append((line[k].x, line[at - 1].x + line[at - 1].w))
    ends = [left for left, _ in spans[1:]] + [line[-1].x + line[-1].w + LAST_REACH]
    return [(left, max(end, right + LEAST_REACH)) for (left, right), end in zip(spans, ends, strict=True)]


def cells_of(line: list[Word], bands: list[tuple[float, float]]) -> list[str]:
    """Words of a line by the column that their middle lies in."""
    return [" ".join(w.word for w in line if left - MARGIN <= w.x + w.w / 2 <= right + MARGIN) for left, right in bands]


def _lines(words: list[tuple]) -> list[list[Word]]:
    return [list(line) for _, line in groupby(map(Word._make, words), lambda w: w.line_no)]


def _said(line: list[Word]) -> str:
    return " ".join(w.word for w in line)


def _spelt(words: DataFrame, key: str) -> DataFrame:
    word = F.col("word")
    return words.select(key, "line_no", "word_no", "word", "x", "w", F.lower(F.regexp_replace("word", r"(?U)[^\w]", "")).alias("bare"), ocr_fold(word).alias("fold"), ocr_simplify(word).alias("simple"))


def _table_below(page: list[list[Word]], said: list[str], head: int, bands: list[tuple[float, float]], stops: re.Pattern) -> dict[int, list[str]]:
    """Line -> cells of the filled lines below a heading, up to another table, a page's end, or the first empty line after rows."""
    rows: dict[int, list[str]] = {}
    for k in range(head + 1, len(page)):
        cells = cells_of(page[k], bands)
        if stops.search(said[k]) or (rows and not any(cells)):
            break
        if any(cells):
            rows[k] = cells
    return rows


def _named(page: list[list[Word]], specs: list[tuple[str, list[str], re.Pattern, re.Pattern]]) -> list[tuple[str, list[str], list[list[str]]]]:
    said, simple = [_said(line) for line in page], [" ".join(w.simple for w in line) for line in page]
    found, taken = [], set()
    for title, headings, opens, stops in specs:
        for k in range(len(page)):
            if k in taken or not (opens.search(said[k]) or opens.search(simple[k])):
                continue
            # headings stand on the title's line or on the next
            head, bands = next(((h, b) for h in (k, k + 1) if h < len(page) and (b := heading_bands(page[h], headings))), (None, None))
            if bands:
                rows = _table_below(page, said, head, bands, stops)
                taken |= {k, head, *rows}
                if rows:
                    found.append((title, headings, list(rows.values())))
                break
    return found


def named_tables(words: DataFrame, key: str, specs: list[tuple[str, list[str], str]] | None = None) -> DataFrame:
    """(key, place, title, headers, rows) of tables (title, headings, opening pattern) on pages of words (line_no, word_no, word, x,
    w). Which lines a table takes depends on the tables before it, so each page is walked as a whole."""
    specs = REGISTER_TABLES if specs is None else specs
    stops = lambda title: "|".join(f"(?:{p})" for t, _, p in specs if t != title) + f"|(?:{PAGE_END})"
    ready = [(t, h, re.compile(p, re.I), re.compile(stops(t).lstrip("|"), re.I)) for t, h, p in specs]

    def walk(page: list[tuple]) -> list[tuple]:
        return [(k, *table) for k, table in enumerate(_named(_lines(page), ready))]

    return walked(_spelt(words, key), key, ["line_no", "word_no"], walk, "place int, title string, headers array<string>, rows array<array<string>>")


def banded_lines(words: DataFrame, key: str, opening: str, headings: list[list[str]]) -> DataFrame:
    """(key, line_no, text, opens, n_heads, cells): lines of pages, each cut by the headings of the last line above it whose folded
    letters match ``opening``; the first list of headings that stands there counts, and without one there are no cells."""
    opens = re.compile(opening)

    def walk(page: list[tuple]) -> list[tuple]:
        out, bands = [], None
        for line in _lines(page):
            head = bool(opens.search("".join(w.fold for w in line)))
            if head:
                bands = next((b for h in headings if (b := heading_bands(line, h))), None)
            out.append((line[0].line_no, _said(line), head, len(bands or []), cells_of(line, bands) if bands and not head else None))
        return out

    return walked(_spelt(words, key), key, ["line_no", "word_no"], walk, "line_no int, text string, opens boolean, n_heads int, cells array<string>")


def slip_events(words: DataFrame, key: str) -> DataFrame:
    """(key, line_no, code, description, reference, amount, discount) of pay slips: by the columns of their headings, else by the
    patterns of event lines, from the heading or the first such line to the messages."""
    c = F.col
    line = banded_lines(words, key, r"(?=.*descricao).*(?:vencimento|referencia|desconto)", SLIP_HEADINGS).withColumn("_t", strip(collapse(c("text"))))
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = c("opens") | c("_t").rlike(flagged(r"c[oó]digo\s+descri", "i"))
    first = head | c("_t").rlike(r"(?U)^\d{4}\b") | c("_t").rlike(flagged(WORDY_EVENT))
    begun = line.withColumn("_head", head).withColumn("_on", F.max(first).over(above)).where("_on")
    told = begun.withColumn("_off", F.max(~c("_head") & ocr_fold(c("_t")).contains("mensagens")).over(above)).where("NOT _off AND NOT _head")
    cell = lambda k: text_cell(c("cells"), c("n_heads"), k)
    money = F.exists("cells", lambda x: x.rlike(flagged(f"^(?:{forms.MONEY})$")))
    filled = F.exists("cells", lambda x: x != "") & (money | (F.get("cells", F.lit(0)) != ""))
    banded = F.when(F.coalesce(filled, F.lit(False)), F.struct(*[cell(k).alias(n) for k, n in enumerate(("code", "description", "reference", "amount", "discount"))]))
    wordy = forms.groups(c("_t"), WORDY_EVENT, ["code", "description", "reference", "amount", "discount"])
    event = told.withColumn("_e", F.coalesce(banded, forms.event_row(c("_t")), wordy)).where("_e IS NOT NULL")
    return event.select(key, "line_no", "_e.code", strip(c("_e.description")).alias("description"), "_e.reference", "_e.amount", "_e.discount")


def text_cell(cells: Column, n_heads: Column, place: int) -> Column:
    """The cell at a place among five columns; headings without a code leave the first one empty."""
    shifted = F.when(n_heads >= 5, cells).otherwise(F.concat(F.array(F.lit("")), cells))
    return F.coalesce(F.get(shifted, F.lit(place)), F.lit(""))
