"""Stamps of the electronic docket: folios, signatures, validation addresses, and the residue without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NBSP, bound, flagged, lines, strip, text_of

# fixed values: the stamp patterns
CASE_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
FOLIO_LINE = r"^\s*Fls\.?\s*:\s*(\d+)(?:\s+(\d+))?\s*$"
FOLIO = r"F[il1]s\.?\s*:\s*(\d+)"
SIGNATURE = r"^\s*Documento assinado eletronicamente por .+?(?:\n|$)"
SIGNATURE_ID = r"Documento assinado eletronicamente por .+?\s*-\s*([0-9A-Za-z]{7})\b"
STAMP_ID = r"^[^\n]*\bassinado eletronicamente por\b[^\n]*-\s*([0-9A-Za-z]{7})\s*$"
ADDRESS = r"https?://[^\s]*pje[^\s]*\.jus\.br\S*"
DOCUMENT_NUMBER = r"N[uú]mero do documento\s*:\s*(\S+)"
PROCESS_NUMBER = r"N[uú]mero do processo\s*:\s*(\S+)"
#: Deleted in this order, each with its flags.
DELETIONS = (
    (FOLIO_LINE, "im"),
    (FOLIO, "i"),
    (SIGNATURE, "im"),
    (r"^\s*Digitally signed by .+?(?:\n|$)", "im"),
    (r"^\s*unico\s*\|\s*sign.*?(?:\n|$)", "im"),
    (r"^\s*Date:\s*.+$", "im"),
    (r"^\s*Reason:\s*.+$", "im"),
    (r"^\s*Location:\s*.*$", "im"),
    (r"^\s*(?:unico\s*\|\s*sign\s*-?\s*)?C[oó]digo do documento\s*:.*$", "im"),
    (r"^\s*P[aá]gina\s+\d+\s*$", "im"),
    (r"^\s*https?://[^\s]*pje[^\s]*\.jus\.br\S*\s*$", "im"),
    (r"^\s*N[uú]mero do documento\s*:\s*\S+\s*$", "im"),
    (r"^\s*N[uú]mero do processo\s*:\s*\S+\s*$", "im"),
    (r"^\s*(?:PJe\s*-\s*\d|PROCESSO JUDICIAL ELETR[OÔ]NICO).*$", "im"),
    (r"^\s*(?:OBSERVA[CÇ][OÕ]ES|Assinador Serpro|Medida Provis[oó]ria).*$", "im"),
    (ADDRESS, "i"),
    (r"^\s*www\.[^\s]+\s*(?:AM\s*\|.*)?\s*$", "im"),
)
#: Lines that a page body loses when it is written out.
BODY_DROPS = (
    r"^\s*Fls[._]?\s*:?\s*\d+(?:\s+\d+)?\s*$",
    r"^\s*Documento assinado eletronicamente por .+?$",
    r"^\s*https?://[^\s]*pje[^\s]*\.jus\.br\S*\s*$",
    r"^\s*N[uú]mero do documento\s*:.*$",
    r"^\s*N[uú]mero do processo\s*:.*$",
    r"^###\s*Quadro\s*/\s*figura\s+\d+\s*$",
)


def plain_spaces(c: Column) -> Column:
    return F.replace(text_of(c), F.lit(NBSP), F.lit(" "))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def residue(c: Column) -> Column:
    """The text without its stamps."""
    out = plain_spaces(c)
    for pattern, flags in DELETIONS:
        out = F.regexp_replace(out, flagged(pattern, flags), "")
    return squeeze(out)


def folios(c: Column) -> Column:
    """All folio numbers, with two overlaid ones (``2`` and ``107`` read as ``2107``) taken apart."""
    t = plain_spaces(c)
    loose = F.regexp_extract_all(t, F.lit(flagged(FOLIO, "i")), F.lit(1))
    second = F.filter(F.regexp_extract_all(t, F.lit(flagged(FOLIO_LINE, "im")), F.lit(2)), lambda x: x != "")

    def apart(v: Column) -> Column:
        s = v.cast("string")
        n = F.length(s)
        out = F.when(v <= 0, F.array().cast("array<bigint>"))
        for k in (1, 2):
            left, right = F.substr(s, F.lit(1), F.lit(k)).cast("long"), F.substr(s, F.lit(k + 1), n).try_cast("long")
            out = out.when(n.between(4, 6) & (n - k >= 3) & left.between(1, 40) & right.between(50, 9999) & (right > left), F.array(left, right))
        return out.otherwise(F.array(v))

    numbers = F.filter(F.transform(F.concat(loose, second), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return F.flatten(F.transform(numbers, apart))


def process_folio(c: Column) -> Column:
    return F.array_max(folios(c))


def _ids(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(flagged(pattern, "im")), F.lit(1)), F.lower))


def signature_ids(c: Column) -> Column:
    return _ids(c, SIGNATURE_ID)


def stamp_ids(c: Column) -> Column:
    """Ids at the end of a line, of new and old stamps."""
    return _ids(c, STAMP_ID)


def signature_lines(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(flagged(BODY_DROPS[1], "im")), F.lit(0)), strip)


def stamp(c: Column) -> Column:
    """struct<fls, signature, signature_ids, validation_url, document_number, process_number, raw_stamp>."""
    t = plain_spaces(c)
    take = lambda pattern, flags, group: F.when(t.rlike(flagged(pattern, flags)), F.regexp_extract(t, flagged(pattern, flags), group))
    fls, signature = process_folio(c), strip(take(SIGNATURE, "im", 0))
    url = F.regexp_replace(take(ADDRESS, "i", 0), r"[.,;)]+\z", "")
    document = take(DOCUMENT_NUMBER, "im", 1)
    process = F.coalesce(take(PROCESS_NUMBER, "im", 1), take(CASE_NUMBER, "", 0))
    raw = F.concat_ws("\n", F.concat(F.lit("Fls.: "), fls.cast("string")), signature, url, F.concat(F.lit("Número do documento: "), document), F.concat(F.lit("Número do processo: "), process))
    return F.struct(fls.alias("fls"), signature.alias("signature"), signature_ids(t).alias("signature_ids"), url.alias("validation_url"), document.alias("document_number"), process.alias("process_number"), raw.alias("raw_stamp"))


def case_number(*sources: Column) -> Column:
    """The first case number in the first source that has one."""
    return F.coalesce(*[F.when(s.rlike(flagged(CASE_NUMBER)), F.regexp_extract(s, flagged(CASE_NUMBER), 0)) for s in sources])


def clean_body(c: Column, keep_signature: Column, signatures: Column) -> Column:
    """A page's body for output; signatures follow where they are kept, and are recovered from the text if none are given."""
    t = text_of(c)
    body = t
    for pattern in BODY_DROPS:
        body = F.regexp_replace(body, flagged(pattern, "im"), "")
    given = F.coalesce(signatures, F.array().cast("array<string>"))
    mine = F.when(F.size(given) > 0, given).otherwise(signature_lines(t))
    signed = F.array_join(F.when(t == "", given).otherwise(mine), "\n")
    kept = F.when(keep_signature, signed).otherwise(F.lit(""))
    joined = lambda x: F.when(x["kept"] == "", F.when(t == "", "").otherwise(x["body"])).otherwise(F.when((x["body"] == "") | (t == ""), x["kept"]).otherwise(F.concat_ws("\n\n", x["body"], x["kept"])))
    return bound(F.struct(squeeze(body).alias("body"), kept.alias("kept")), joined)


def non_blank(c: Column) -> Column:
    return F.filter(lines(c), lambda x: strip(x) != "")
