"""Document statistics, and decision lists learned from labelled statistics by sequential covering.

The statistics are column expressions over a text's words. The learner reads a bounded sample of labelled rows (at most
``max_rows``, the rows with the smallest hash of their id), grows conjunctions of thresholds one literal at a time on
two thirds of it, prunes them on the rest, and keeps a rule only where it is precise enough there. The list is emitted as
one ordered conditional expression: first rule that fits rejects, else the document is kept.

Defined results: a null text has no words and fails the base rule; a document without a label is judged all the same; a
label that is null is not used, and of several labels of one id each row counts; without labels of both kinds the list is
empty and only the base rule rejects; repeated rows are judged one by one; other columns pass through, but those with the
name of a statistic, which ``with_statistics`` and ``apply_rules`` replace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeat_words(hashes: Column) -> Column:
    """How many words lie in a window of five words that occurs twice or more, from the words' hashes."""
    n = F.size(hashes)
    windows = F.transform(F.slice(hashes, F.lit(1), n - (WINDOW - 1)), lambda _, i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def starts(w: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        found = F.filter(F.transform(w, lambda x, k: F.when(same(x, F.get(w, k - 1)) | same(x, F.get(w, k + 1)), x["i"])), lambda x: x.isNotNull())
        return F.sort_array(found)

    def covered(s: Column) -> Column:
        lengths = F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(once(once(F.sort_array(windows), starts), covered))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits and n_marks."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.withColumn("_word_hashes", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_filled_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_word_hashes").cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": (F.size("_filled_lines") - F.size(F.array_distinct("_filled_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_word_hashes")),
        "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": without("0123456789"),
        "n_marks": without("!?"),
    })
    return out.drop("_word_hashes", "_filled_lines")


def _per(a: str, b: str) -> str:
    return f"coalesce(try_divide(cast({a} as double), {b}), 0D)"


#: What rules may test: name and SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": _per("word_chars", "n_words"),
    "symbols_per_word": _per("n_symbols", "n_words"),
    "dup_lines_per_word": _per("n_dup_lines", "n_words"),
    "repeat_share": _per("n_repeat_words", "n_words"),
    "upper_share": _per("n_upper", "word_chars"),
    "digit_share": _per("n_digits", "word_chars"),
    "marks_per_word": _per("n_marks", "n_words"),
}


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def fits(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Literal, ...]


def _fits(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for one in rule:
        hit &= one.fits(x)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Adds the literal with the largest FOIL gain until no good row is left in the rule."""
    rule: tuple[Literal, ...] = ()
    hit = np.ones(len(x), bool)
    while len(rule) < most and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(FEATURES):
            v = x[hit, j]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[hit][order]
            ends = np.flatnonzero(v[:-1] < v[1:])  # a cut lies between two different values
            if not len(ends):
                continue
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, min(cuts, len(ends))).astype(int))]
            below = np.cumsum(b)[ends]
            for above, p, n in ((False, below, ends + 1 - below), (True, b.sum() - below, len(b) - ends - 1 - b.sum() + below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Literal(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)), g[k]
        if best is None:
            break
        rule += (best,)
        hit &= best.fits(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drops last literals as long as that doesn't lower the rule's worth on rows it wasn't grown on."""
    def worth(r: Rule) -> float:
        hit = _fits(r, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_literals: int = 3, precision: float = 0.95, least: int = 3, cuts: int = 64) -> list[Rule]:
    """Ordered rules that reject, from rows of ``FEATURES`` and whether each row is bad."""
    rules: list[Rule] = []
    for k in range(most_rules * 2):
        if len(rules) == most_rules or not bad.any() or bad.all():
            break
        held = (np.arange(len(x)) + k) % 3 == 0
        rule = _prune(_grow(x[~held], bad[~held], most_literals, cuts), x[held], bad[held])
        hit = _fits(rule, x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        ph, nh = (hit & bad & held).sum(), (hit & ~bad & held).sum()
        if rule and p >= least and p >= precision * (p + n) and ph >= precision * (ph + nh):
            rules.append(rule)
            x, bad = x[~hit], bad[~hit]
    return rules


def rejects(rules: list[Rule]) -> str:
    """The list as one ordered SQL conditional: number of the first rule that fits, from 1, else 0."""
    if not rules:
        return "0"
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'({x.sql()})' for x in r)} THEN {k}" for k, r in enumerate(rules, 1)) + " ELSE 0 END"


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Learns from at most ``max_rows`` labelled rows, those with the smallest hash of their id."""
    h = F.xxhash64("_id")
    sample = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull()).orderBy(h, "_id", "_label").limit(max_rows)
    # the sample has at most max_rows rows of two numbers, which bounds the broadcast
    known = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id")
    rows = with_statistics(known).select("_id", "_label", *[F.expr(s).alias(n) for n, s in FEATURES.items()]).orderBy(h, "_id", "_label", *FEATURES).limit(max_rows).collect()
    if not rows:
        return []
    return learn(np.array([list(r[2:]) for r in rows], float), np.array([r[1] == 0 for r in rows]))


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (number of the rule that rejects, else 0) and ``kept``."""
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    out = with_statistics(docs, text).withColumn("base_failed", base).withColumn("rule", F.expr(rejects(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_only(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a learned one rejects."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("text"))
    judged = apply_rules(packed, rules).withColumn("_row", F.monotonically_increasing_id())
    # the row number keeps Spark from moving the filter below the statistics, where each mention of one would compute it anew
    return judged.where("kept AND _row >= 0").select("_doc.*")
