"""Column functions over text: white space, lines, folding, and the rules for regular expressions.

The patterns were written for an engine in which case folding, ``\\w``, ``\\d`` and ``\\s`` are Unicode-aware and lines end at
``\\n`` only; the flags ``U``, ``u`` and ``d`` give Java's engine the same meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
#: White space as Java's ``(?U)\\s`` has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: letters that folding maps one to one
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"


def flagged(pattern: str, flags: str = "") -> str:
    """``pattern`` with the given flags of ``i`` (case), ``m`` (lines) and ``s`` (dot takes newlines), read as Unicode."""
    return f"(?{flags}dU)" + pattern


#: A word boundary between ASCII characters; Java's own takes the letters of every script for parts of words.
_ASCII_BOUNDARY = r"(?-iu:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def flagged_ascii(pattern: str, flags: str = "") -> str:
    """``pattern`` with the given flags, as DuckDB reads it: ``\\b``, ``\\w``, ``\\d`` and ``\\s`` know ASCII only, case folding all letters."""
    return f"(?{flags}du)" + pattern.replace(r"\b", _ASCII_BOUNDARY)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)``, where the value is worked out once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_line(c: Column) -> Column:
    return collapse(F.lower(text_of(c)))


def lines(c: Column) -> Column:
    """Lines of a text; the empty piece after a final newline is none."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return bound(F.split(c, "\n", -1), cut)


def filled_lines(c: Column) -> Column:
    return F.filter(lines(text_of(c)), lambda x: x.rlike(r"(?U)\S"))


def words_of_collapsed(s: Column) -> Column:
    return F.when(s == "", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)


def word_count(c: Column) -> Column:
    return bound(collapse(text_of(c)), words_of_collapsed)


def fold(c: Column) -> Column:
    """Without accents, lower case, white space collapsed."""
    return collapse(F.lower(F.translate(text_of(c), ACCENTED, PLAIN)))


def ocr_simplify(c: Column) -> Column:
    """Lower case without accents, and the usual misreadings of ``ção`` undone."""
    out = F.lower(F.translate(text_of(c), ACCENTED, PLAIN))
    # fixed values: misreadings and what they stand for
    for wrong, right in (("gao", "cao"), ("goes", "coes"), ("gdo", "cao"), ("emorecador", "empregador"), ("empreaador", "empregador")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def ocr_fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(ocr_simplify(c), r"(?U)[^\w]", ""))


def replace_all(c: Column, rules) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def safe_name(c: Column) -> Column:
    """A name that can be a file's: other characters become ``_``, 180 at most, ``documento`` if nothing is left."""
    cut = F.substr(F.regexp_replace(strip(text_of(c)), r"(?U)[^\w.\-]+", "_"), F.lit(1), F.lit(180))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("documento"))


def escape_html(c: Column) -> Column:
    out = text_of(c)
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def decode_markup(c: Column) -> Column:
    """Text of XML or HTML: tags dropped, seven entities decoded, white space collapsed."""
    out = F.regexp_replace(text_of(c), "<[^>]+>", "")
    for entity, shown in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(shown))
    return collapse(out)
