"""Column functions that judge pages: images, usable text, kinds of documents, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stamps import residue
from .text import bound, flagged, fold, lines, norm_line, strip, text_of

A4_WIDTH, A4_HEIGHT = 595.0, 842.0
# fixed values: markers, hints and lists
FLUFF = ("date:", "reason:", "location:", "este material foi criado", "página ")
LONG_WORD = "[A-Za-zÀ-ÿÁÉÍÓÚÂÊÔÃÕÇáéíóúâêôãõç]{4,}"
HINTS = (
    "parágrafo", "paragrafo", "cláusula", "clausula", "empregado", "empresa", "trabalho", "convenção", "convencao", "contrato", "artigo", "salário", "salario", "hora", "sindicato", "fgts", "clt",
    "rescisão", "rescisao", "petição", "peticao", "contestação", "contestacao", "réplica", "replica", "intimação", "intimacao", "despacho", "audiência", "audiencia", "testemunha", "número", "numero", "registro",
)
FORCED = (
    "termo de rescisão de contrato de trabalho", "trct", "comunicação de dispensa e seguro desemprego", "cd/sd", "ficha de registro de empregado", "ficha de registro", "contracheque/recibo de salário", "contracheque/recibo",
    "contracheque", "recibo de salário", "extrato de fgts", "documento de identificação", "carteira de trabalho e previdência social", "ctps", "convenção coletiva", "convencao coletiva", "trabalho (cct)", "(cct)", "acordo coletivo", "trabalho (act)", "(act)",
)
PETITIONS = ("petição inicial", "contestação", "réplica", "manifestação")
GENERIC = ("despacho", "intimação", "certidão", "ata da audiência", "documento diverso", "solicitação de habilitação")
PRESERVED = ("intimacao", "despacho", "decisao", "sentenca")
ORDINALS = "primeira|segunda|terceira|quarta|quinta|sexta|s[eé]tima|oitava|nona|d[eé]cima"
FORM_KINDS = ("trct", "cd_sd", "ficha_registro", "recibo", "fgts", "identidade", "ctps")


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has(c: Column, *words: str) -> Column:
    return any_of(c.contains(w) for w in words)


class Image:
    """Predicates over the columns of one embedded image, after their names."""

    def __init__(self, prefix: str = ""):
        self.w, self.h = F.col(prefix + "width"), F.col(prefix + "height")
        self.y, self.shown_w, self.shown_h = (F.col(prefix + n) for n in ("y", "display_width", "display_height"))
        self.page_w, self.page_h = F.col(prefix + "page_width"), F.col(prefix + "page_height")

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def logo(self) -> Column:
        return ((F.greatest(self.w, self.h) <= 120) & (self.area <= 25_000)) | ((self.w <= 150) & (self.h <= 150))

    @property
    def letterhead_strip(self) -> Column:
        return (self.w >= 1200) & (self.h <= 400) & (self.w > 2.5 * self.h)

    @property
    def id_strip(self) -> Column:
        return (self.w >= 600) & (self.h <= 220) & (self.w > 2 * self.h)

    @property
    def height_ratio(self) -> Column:
        return F.coalesce(self.shown_h, self.h.cast("double")) / F.when(F.coalesce(self.page_h, F.lit(0.0)) != 0, self.page_h).otherwise(A4_HEIGHT)

    @property
    def width_ratio(self) -> Column:
        return F.coalesce(self.shown_w, self.w.cast("double")) / F.when(F.coalesce(self.page_w, F.lit(0.0)) != 0, self.page_w).otherwise(A4_WIDTH)

    @property
    def placed(self) -> Column:
        return self.y.isNotNull() & (F.coalesce(self.page_h, F.lit(0.0)) != 0)

    @property
    def header_banner(self) -> Column:
        top = self.y / self.page_h
        wide = (self.width_ratio >= 0.45) | (F.coalesce(self.shown_w, self.w.cast("double")) > 2 * F.coalesce(self.shown_h, self.h.cast("double")))
        return F.when(self.id_strip, False).when(self.placed, (top <= 0.18) & (self.height_ratio <= 0.22) & wide).otherwise(self.letterhead_strip)

    @property
    def footer_banner(self) -> Column:
        bottom = (self.y + F.coalesce(self.shown_h, self.h.cast("double"))) / self.page_h
        return F.when(self.id_strip | ~self.placed, False).otherwise((bottom >= 0.85) & (self.height_ratio <= 0.18))

    @property
    def full_scan(self) -> Column:
        return (self.w >= 1500) & (self.h >= 2000)

    @property
    def aspect(self) -> Column:
        return F.when(self.w > 0, self.h / self.w).otherwise(0.0)

    @property
    def content(self) -> Column:
        big = (self.area >= 40_000) & (self.h >= 200)
        tall = (self.h >= 900) & (self.aspect >= 1.6)
        return F.when(self.logo, False).when(self.id_strip, True).when(self.header_banner | self.footer_banner, False).otherwise(self.full_scan | big | tall)


def overlay_only(c: Column, least: int = 200) -> Column:
    """Whether too little is left beside certificate lines."""
    rest = lambda t: F.filter(lines(t), lambda x: (strip(x) != "") & bound(F.lower(x), lambda low: ~has(low, *FLUFF)))
    return bound(strip(text_of(c)), lambda t: (F.length(t) < least) | (F.length(strip(F.array_join(rest(t), "\n"))) < least))


def usable(c: Column, least: int = 200) -> Column:
    """Whether the text layer reads like a document rather than a broken encoding."""
    return ~overlay_only(c, least) & readable(c)


def readable(c: Column) -> Column:
    """``usable`` for a text that is known to be no overlay."""
    def judged(t: Column) -> Column:
        letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))
        solid = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
        controls = F.length(t) - F.length(F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]+", ""))
        share = F.coalesce(F.try_divide(letters, solid), F.lit(0.0)) >= 0.45
        hinted = bound(F.lower(t), lambda low: has(low, *HINTS))
        enough = bound(F.regexp_count(t, F.lit(LONG_WORD)), lambda words: (words >= 40) | ((words >= 20) & hinted))
        return enough & share & (controls <= 20)

    return bound(strip(text_of(c)), judged)


def ocr_usable(c: Column, least: int = 40) -> Column:
    """Whether recognised text has content beside stamps and watermarks."""
    t = residue(c)
    for pattern in (flagged(r"\bPJe\b", "i"), flagged(r"\bFls\.?\s*:?\s*\d+\b", "i"), flagged(r"\bDocumento\s+assinado\b[\s\S]*", "i")):
        t = F.regexp_replace(t, pattern, " ")
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) >= least


def _cct(t: Column) -> Column:
    return t.rlike(r"(?U)conven[cçg][aãá]?o\s+coletiva") | t.rlike("(?<![a-z0-9])cct(?![a-z0-9])")


def _act(t: Column) -> Column:
    return t.contains("acordo coletivo de trabalho") | t.rlike(r"(?U)trabalho\s*\(act\)") | (t.rlike("(?<![a-z0-9])act(?![a-z0-9])") & t.contains("coletivo"))


def _clauses(t: Column) -> Column:
    named = t.rlike(rf"(?U)cl[aá]usula\s+({ORDINALS})")
    paragraph = t.rlike(r"(?U)par[aá]grafo\s+(primeiro|segundo|terceiro|quarto|quinto|sexto)") & t.rlike("sindicato|categoria|empregad|piso salarial|data-base")
    return t.rlike("cl[aá]usula") & (named | (F.regexp_count(t, F.lit("cl[aá]usula")) >= 2) | paragraph)


def kind_of_text(c: Column) -> Column:
    """Kind of a document by its words; collective agreements first, as they quote the other forms."""
    t = F.lower(text_of(c))
    # fixed values: the words of each kind, in the order in which they count
    ladder = (
        (_cct(t) | _clauses(t), "cct"),
        (_act(t), "act"),
        (t.contains("termo de homologação de rescisão") | (t.contains("termo de rescisão") & t.contains("contrato de trabalho")) | t.rlike(r"(?U)\btrct\b"), "trct"),
        (has(t, "comunicação de dispensa", "seguro-desemprego", "seguro desemprego") | (t.contains("requerimento") & t.contains("seguro") & t.contains("desemprego")), "cd_sd"),
        (t.contains("ficha de registro de empregado"), "ficha_registro"),
        (has(t, "recibo de pagamento", "contracheque"), "recibo"),
        (t.contains("extrato") & t.contains("fgts"), "fgts"),
        (has(t, "carteira nacional de habilita", "senatran") | (t.contains("habilita") & has(t, "cnh", "driver license")), "cnh"),
        (has(t, "documento de identificação", "carteira de identidade"), "identidade"),
    )
    return _ladder(ladder)


def kind_of_index(tipo: Column, titulo: Column) -> Column:
    """Kind of a document by its row in the index."""
    t = norm_line(F.concat_ws(" ", text_of(tipo), text_of(titulo)))
    # fixed values: the words of each kind, in the order in which they count
    ladder = (
        (has(t, "trct", "termo de rescisão"), "trct"),
        (has(t, "cd/sd", "comunicação de dispensa") | (t.contains("seguro") & t.contains("desemprego")), "cd_sd"),
        (t.contains("ficha de registro"), "ficha_registro"),
        (has(t, "contracheque", "recibo de salário", "recibo de salario"), "recibo"),
        (t.contains("fgts") & t.contains("extrato"), "fgts"),
        (t.contains("identificação") & t.contains("documento"), "identidade"),
        (t.contains("carteira de trabalho") | t.rlike(r"(?U)\bctps\b"), "ctps"),
        (_cct(t), "cct"),
        (_act(t), "act"),
    )
    return _ladder(ladder)


def _ladder(rules) -> Column:
    return reduce(lambda chain, r: chain.when(r[0], r[1]), rules, F.when(F.lit(False), F.lit(None).cast("string")))


def forced_form(tipo: Column, titulo: Column) -> Column:
    return has(F.concat_ws(" ", norm_line(tipo), norm_line(titulo)), *FORCED)


def petition_like(tipo: Column) -> Column:
    return has(norm_line(tipo), *PETITIONS)


def generic(tipo: Column) -> Column:
    t = norm_line(tipo)
    return t.contains("documento diverso") | any_of(t.startswith(k) for k in GENERIC)


def preserved(tipo: Column) -> Column:
    """Acts whose closing lines stay."""
    t = fold(tipo)
    return any_of((t == k) | t.startswith(k + " ") | t.startswith(k + "(") for k in PRESERVED)


def page_class(forced: Column, overlay: Column, is_usable: Column, figures: Column) -> Column:
    return F.when((forced & ~is_usable) | overlay, "image_page").when(is_usable, F.when(figures > 0, "hybrid").otherwise("native")).otherwise(F.when(figures > 0, "image_page").otherwise("native"))


def subtype(cls: Column, tall: Column, strips: Column, scans: Column, figures: Column) -> Column:
    """Finer class, from whether a tall figure is there, and how many strips, full scans and figures."""
    return F.when(cls == "hybrid", "petition_hybrid").when(cls == "native", "native_text").when(tall > 0, "print_chat").when(strips >= 3, "govbr_strip_id").when(scans > 0, "a4_scan").when(figures == 0, "vector_outline").otherwise("image_page")


def dpi(kind: Column, sub: Column, page: int = 300, form: int = 300, screenshot: int = 220) -> Column:
    return F.when(sub == "print_chat", screenshot).when(kind.isin(*FORM_KINDS, "cnh"), form).otherwise(page)
