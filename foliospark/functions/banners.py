"""Column functions over single lines of a page's bands: person names, contacts, banners.

``read`` gives the patterns their flags: ``flagged`` knows words of every script, ``flagged_ascii`` parts words as the queries' SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flagged, norm_line, strip, text_of, word_count

# fixed values: the line patterns
EMAIL = r"[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"
PHONE = r"(?:\+55\s*)?(?:\(\s*\d{2}\s*\)|\b\d{2}\b)\s*(?:9\s*)?\d{4,5}[-\s]?\d{4}\b"
BULLETS = r"^[\s●•·‣▪\-–—*]+"
POSTAL_CODE = r"\b\d{5}-\d{3}\b"
BAR_NUMBER = r"\bOAB(?:/[A-Z]{2})?\s*(?:n[ºo°.]?\s*)?\d"
URL = r"\b(?:https?://|www\.)\S+"
FIRM = r"\b(?:sociedade\s+de\s+advogados|advogados\s+associados|escrit[oó]rio\s+de\s+advocacia|advocacia\s+\w+)\b"
STREET = r"^\s*(?:rua|r\.|av(?:enida)?\.?|al(?:ameda)?\.?|pra[cç]a|pc\.|travessa|tv\.|rod(?:ovia)?\.?)\b"
PARTICLE = r"^(d[aeo]s?|e)$"
KEEP = r"\b(?:excelent[ií]ssim|merit[ií]ssim|juiz|ju[ií]za|vara|reclamante|reclamad[ao]|autor[ae]?|r[eé]u|processo|n[uú]cleo|f[oó]rum|tribunal|agravo|recurso|embargos|fls\.?|p[aá]gina)\b"
ACCOUNT = r"^(?:CPF|CNPJ|PIX|Banco|Ag[eê]ncia|Conta|Chave)\b"
NAME_WORD = r"[A-Za-zÀ-ÿ'.]+"
#: No longer line, folded, is a contact or a banner.
LONGEST = 90


Read = Callable[..., str]


def _fits(c: Column, *patterns: str, read: Read = flagged) -> Column:
    out = c.rlike(read(patterns[0], "i"))
    for p in patterns[1:]:
        out = out | c.rlike(read(p, "i"))
    return out


def person_name(line: Column, read: Read = flagged) -> Column:
    """A short signature-like name."""
    s = strip(text_of(line))
    words = F.filter(F.regexp_extract_all(s, F.lit(NAME_WORD), F.lit(0)), lambda w: ~w.rlike(flagged(PARTICLE, "i")))
    n = F.size(words)
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    other = _fits(s, BAR_NUMBER, FIRM, "advogad", EMAIL, URL, read=read) | s.rlike(read(PHONE)) | s.rlike(read(r"\d"))
    return (s != "") & ~other & n.between(2, 6) & (capitals >= F.greatest(F.lit(2), n - 1))


def contact(line: Column, read: Read = flagged) -> Column:
    """A short line with an address, a number or a name of an office; prose that cites one isn't."""
    s = strip(text_of(line))
    short = (F.length(norm_line(s)) <= LONGEST) & (word_count(s) <= 12)
    return (s != "") & short & ~_fits(s, KEEP, read=read) & (_fits(s, EMAIL, BAR_NUMBER, URL, FIRM, STREET, read=read) | s.rlike(read(PHONE)) | s.rlike(read(POSTAL_CODE)))


def banner(line: Column, read: Read = flagged) -> Column:
    """Short chrome that may repeat from page to page."""
    s = strip(text_of(line))
    lead = F.regexp_replace(F.regexp_replace(s, flagged(BULLETS), ""), r"(?U)^\s+", "")
    return F.length(norm_line(s)).between(8, 70) & ~_fits(s, KEEP, read=read) & ~person_name(s, read) & (word_count(s) <= 10) & ~lead.rlike(r"^\p{Ll}") & ~_fits(lead, ACCOUNT, read=read)
