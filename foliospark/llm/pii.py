"""Format-preserving Feistel pseudonyms for personal data, in column expressions only.

E-mail addresses, IPv4 addresses, payment cards (Luhn-valid), US social security numbers, IBAN (mod 97-valid), phone
numbers, dates and long numbers are found and replaced inside the text. Each is mapped by a keyed Feistel network over its
own characters: a digit stays a digit, a letter a letter of its case, separators stay where they are. The map is a
permutation of the canonical value (digits or letters without separators), so equal values get equal pseudonyms in all
documents however they are written, and different values different ones. Checked numbers stay valid: the last digit of
a card is recomputed, IPv4 parts stay below 256, dates stay dates (cycle-walked day numbers).

A run of digits in groups is read from its left: its longest beginning of whole groups that has 13 to 19 digits and a
valid Luhn sum is the card, and what follows (an expiry date, another number) is mapped on its own; where no beginning is valid,
the whole run is mapped as a number, so no number with a wrong check stays in clear text. A date may be written year
first, day first or month first (where the day is above 12), with one or two digits for day and month. A date
that the calendar lacks, or outside the years from 1900 to 2100, stays. Of an e-mail address the part before the ``@`` is mapped in lower
case, as addresses are equal whatever their case, and the domain, which is not personal, stays as written.

Defined results: a null text stays null, an empty one empty; leftmost matches win, in the order of ``ORDER`` at equal
start; rows are mapped one by one, so repeated rows agree; ``text`` is replaced in place, ``pii`` is added (or replaced),
and all other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: the patterns, each of one kind, without capturing groups; a guard at the start keeps matches off longer runs. Java
# matches a group that repeats by recursion, so repetitions are bounded (a domain has 127 labels at most) or possessive
KINDS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){0,125}\\.[A-Za-z]{2,}",
    "ip": f"(?<![0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![0-9]|\\.[0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": "(?<![0-9/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9+])(?:\\+[0-9]{1,3}[\\x20.-]?)?(?:\\([0-9]{2,4}\\)[\\x20.-]?|[0-9]{2,4}[\\x20.-])[0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9]|[\\x20.-][0-9]{3,4}(?![0-9]))|(?<![0-9+])\\+[0-9]{1,3}(?:[\\x20.-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{4}(?:[\\x20-][0-9]{4}){3}(?:[\\x20-][0-9]{1,3})?(?![0-9])|(?=[0-9](?:[\\x20-]?[0-9]){12})(?:[0-9]{13,}+|[0-9]{3,}+(?:[\\x20-][0-9]{3,}+)++)(?![0-9]))",
}
#: Cards go first among the numbers, or their groups would read as phone numbers.
ORDER = ("email", "ip", "iban", "card", "date", "ssn", "phone")
PATTERN = "|".join(f"(?:{KINDS[k]})" for k in ORDER)
ROUNDS = 8
#: Characters that are put together at a time.
BLOCK = 256
#: Dates between these move within them, others are left alone; days are counted from the first.
FIRST_DAY, DAYS = "1900-01-01", 73_414


def _shift(c: Column, by: Column) -> Column:
    def turn(alphabet: str) -> Column:
        n = len(alphabet)
        at = F.instr(F.lit(alphabet), c) - 1
        return F.substr(F.lit(alphabet), F.pmod(at + by, F.lit(n)) + 1, F.lit(1))

    return F.when(c.rlike("^[0-9]$"), turn(DIGITS)).when(c.rlike("^[a-z]$"), turn(LOWERS)).when(c.rlike("^[A-Z]$"), turn(UPPERS)).otherwise(c)


def _moved(target: Column, other: Column, key: str, r: Column, sign: int) -> Column:
    """``target`` with each character moved by what ``other``, the key and the round give."""
    stream = F.sha2(F.concat(F.lit(f"{key}\x1f"), r.cast("string"), F.lit("\x1f"), F.length(target).cast("string"), F.lit("\x1f"), other), 512)
    chars = F.transform(F.split(target, ""), lambda c, i: _shift(c, F.lit(sign) * F.conv(F.substr(stream, F.pmod(i, F.lit(42)) * 3 + 1, F.lit(3)), 16, 10).cast("int")))
    return F.when(target == "", target).otherwise(F.array_join(chars, ""))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def feistel(value: Column, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of strings that keeps the class of every character. The halves change places after each of an
    even number of rounds, so every character ends where it began."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))

    def there(s: Column, r: Column) -> Column:
        return F.struct(s["b"].alias("a"), _moved(s["a"], s["b"], key, r, 1).alias("b"))

    def back(s: Column, r: Column) -> Column:
        return F.struct(_moved(s["b"], s["a"], key, r, -1).alias("a"), s["a"].alias("b"))

    rounds = F.lit(list(range(ROUNDS))[:: -1 if inverse else 1])
    return F.aggregate(rounds, start, back if inverse else there, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _iban_valid(compact: Column) -> Column:
    """Mod 97 of the rearranged number is 1."""
    turned = F.concat(F.substr(compact, F.lit(5), F.length(compact)), F.substr(compact, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _refill(match: Column, canonical: Column, drop: str) -> Column:
    """``match`` with its characters outside class ``drop`` replaced by those of ``canonical``, in order; block by block, as a
    string that grows is copied with each character."""
    def one(part: Column, source: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            kept = c.rlike(drop)
            return F.struct((acc["k"] + F.when(kept, 0).otherwise(1)).alias("k"), F.concat(acc["out"], F.when(kept, c).otherwise(F.substr(source, acc["k"], F.lit(1)))).alias("out"))

        return F.aggregate(F.split(part, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("out")), put, lambda a: a["out"])

    def block(both: Column, b: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(both["m"], F.lit(1), b * BLOCK), drop, ""))
        return one(F.substr(both["m"], b * BLOCK + 1, F.lit(BLOCK)), F.substr(both["c"], before + 1, F.lit(BLOCK)))

    def long(both: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.length(both["m"]) - 1) / BLOCK).cast("int"))
        return F.array_join(F.transform(blocks, lambda b: block(both, b)), "")

    return F.when(F.length(match) <= BLOCK, one(match, canonical)).otherwise(_bind(F.struct(match.alias("m"), canonical.alias("c")), long))


def _numeric(match: Column, key: str, drop: str = "[^0-9]") -> Column:
    return _refill(match, feistel(F.regexp_replace(match, drop, ""), key), drop)


def _walk(value: Column, step: Callable[[Column], Column], good: Callable[[Column], Column], most: int = 24) -> Column:
    """Cycle-walking: steps from a good value until a good one is reached; ``value`` itself if ``most`` steps don't."""
    state = F.struct(step(value).alias("x"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: F.struct(F.when(good(s["x"]), s["x"]).otherwise(step(s["x"])).alias("x")), lambda s: s["x"])
    return _bind(walked, lambda x: F.when(good(x), x).otherwise(value))


def _card_end(match: Column) -> Column:
    """Length of the longest beginning of whole groups that is a valid card number, else 0."""
    def digits(p: Column) -> Column:
        return F.regexp_replace(F.substr(match, F.lit(1), p), "[^0-9]", "")

    def valid(p: Column) -> Column:
        ends = F.substr(match, p, F.lit(2)).rlike("^[0-9](?:[^0-9]|$)")
        return ends & _bind(digits(p), lambda d: F.length(d).between(13, 19) & (F.pmod(luhn_sum(d), F.lit(10)) == 0))

    # 19 digits have at most 18 separators between them
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(13), F.least(F.length(match), F.lit(37))), valid)), F.lit(0))


def _card(match: Column, key: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return _bind(feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), key), lambda p: _refill(match, F.concat(p, _check_digit(p)), "[^0-9]"))


def _moved_date(match: Column, parts: Column, key: str) -> Column:
    """The date's pseudonym in the order, and with the separators and digits, of ``match``; null where it is none."""
    a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
    year_first, month_first = F.length(a) == 4, (b.cast("int") > 12) & (a.cast("int") <= 12)
    y, m, d = (F.when(year_first, x).when(month_first, z).otherwise(w) for x, z, w in ((a, c, c), (b, a, b), (c, b, a)))
    day = F.datediff(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    moved = _walk(F.lpad(day.cast("string"), 5, "0"), lambda x: feistel(x, key + "d"), lambda x: x.cast("int") < DAYS)
    written = lambda new, form, old: F.lpad(F.date_format(new, form), F.greatest(F.length(F.date_format(new, form)), F.length(old)), F.lit("0"))

    def put(new: Column) -> Column:
        ny, nm, nd = written(new, "yyyy", y), written(new, "M", m), written(new, "d", d)
        gap = F.substr(match, F.length(a) + 1, F.lit(1))
        first, last = F.when(year_first, ny).when(month_first, nm).otherwise(nd), F.when(year_first, nd).otherwise(ny)
        return F.concat(first, gap, F.when(year_first | ~month_first, nm).otherwise(nd), gap, last)

    return F.when((day >= 0) & (day < DAYS), _bind(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), put))


def pseudonym(match: Column, key: str) -> Column:
    """struct<kind,value>: the kind of a match of ``PATTERN`` (null where a check fails), and what replaces it."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    is_kind = {k: match.rlike(f"^(?:{KINDS[k]})$") for k in ORDER}
    octets = F.transform(F.split(match, "\\."), lambda p: p.cast("int"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    ip_hex = F.lower(F.lpad(F.hex(number), 8, "0"))
    ip_new = _bind(_hex_feistel(ip_hex, key), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    email_new = F.concat(feistel(F.lower(local), key), F.lit("@"), domain)
    card_new = _bind(_card_end(match), lambda end: F.when(end == 0, _numeric(match, key)).otherwise(F.concat(_card(F.substr(match, F.lit(1), end), key), _numeric(F.substr(match, end + 1, F.length(match)), key))))
    date_new = _bind(F.split(match, "[/.-]"), lambda p: _moved_date(match, p, key))
    compact = F.regexp_replace(match, "\\x20", "")
    bban = F.substr(compact, F.lit(5), F.length(compact))
    iban_new = _bind(F.concat(F.substr(compact, F.lit(1), F.lit(2)), F.lit("00"), feistel(bban, key)), lambda x: _refill(match, _iban_checked(x), "\\x20"))
    n = F.length(digits)
    kept = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"))
    made = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return (
        F.when(is_kind["email"], made("email", email_new))
        .when(is_kind["ip"], made("ip", ip_new))
        .when(is_kind["iban"] & _iban_valid(compact), made("iban", iban_new))
        .when(is_kind["card"], F.struct(F.when(_card_end(match) > 0, "card").otherwise("number").alias("kind"), card_new.alias("value")))
        .when(is_kind["date"], _bind(date_new, lambda d: F.when(d.isNull(), kept).otherwise(made("date", d))))
        .when(is_kind["ssn"], made("ssn", _numeric(match, key)))
        .when(is_kind["phone"] & (n >= 8) & (n <= 15), made("phone", _numeric(match, key)))
        .otherwise(kept)
    )


def _hex_feistel(h: Column, key: str) -> Column:
    """Balanced Feistel network over 32 bits, written as eight hex digits."""
    part = lambda at: F.conv(F.substr(h, F.lit(at), F.lit(4)), 16, 10).cast("int")

    def step(s: Column, r: Column) -> Column:
        f = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{key}\x1fip"), r.cast("string"), F.lit("\x1f"), s["b"].cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
        return F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(f).alias("b"))

    return F.aggregate(F.lit(list(range(ROUNDS))), F.struct(part(1).alias("a"), part(5).alias("b")), step, lambda s: F.concat(F.lpad(F.hex(s["a"]), 4, "0"), F.lpad(F.hex(s["b"]), 4, "0")))


def _check_digit(payload: Column) -> Column:
    return F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")


def _iban_checked(zeroed: Column) -> Column:
    turned = F.concat(F.substr(zeroed, F.lit(5), F.length(zeroed)), F.substr(zeroed, F.lit(1), F.lit(4)))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substr(zeroed, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(zeroed, F.lit(5), F.length(zeroed)))


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``pii`` (array<struct<kind,value>>: what was put in, in order)."""
    t = F.col(text)
    parts = F.struct(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)).alias("m"), F.split(t, PATTERN, -1).alias("s"))

    def rewrite(p: Column) -> Column:
        return F.struct(p["s"].alias("s"), F.transform(p["m"], lambda m: pseudonym(m, key)).alias("m"))

    def join(p: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(p["s"], lambda s, i: F.concat(s, F.coalesce(F.get(p["m"], i)["value"], F.lit("")))), "").alias("text"),
            F.filter(p["m"], lambda m: m["kind"].isNotNull()).alias("pii"),
        )

    found = F.when(t.rlike(PATTERN), _bind(_bind(parts, rewrite), join))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    judged = docs.select(F.struct("*").alias("_doc"), found.alias("_pii"))
    columns = [F.coalesce("_pii.text", f"_doc.`{c}`").alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != "pii"]
    return judged.select(*columns, F.coalesce("_pii.pii", none).alias("pii"))
