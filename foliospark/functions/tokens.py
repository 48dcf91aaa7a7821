"""Token budgets: heuristic counts, limits, divergence from an estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, collapse, flagged, text_of, words_of_collapsed

# fixed values: characters for a token, tokens for a word
FACTORS = {"openai": (2.05, 1.5), "gemini": (1.7, 1.8)}
CONTEXT_LIMIT, DIVERGENCE, MARGIN = 800_000, 0.20, 1.06
ESTIMATE = r"Total estimado \(documentos selecionados / arquivo sanitizado\):\s*openai=(\d+)\s+gemini=(\d+)"


def _heuristic(t: Column, provider: str) -> Column:
    per_char, per_word = FACTORS[provider]
    return F.greatest(F.floor(F.length(t) / F.lit(per_char)), F.floor(words_of_collapsed(t) * F.lit(per_word))).cast("long")


def heuristic(c: Column, provider: str) -> Column:
    """max(characters / a, words * b), each rounded down, over collapsed text."""
    return bound(collapse(text_of(c)), lambda t: _heuristic(t, provider))


def heuristics(c: Column) -> Column:
    """struct of the counts of all providers; the text is collapsed once."""
    return bound(collapse(text_of(c)), lambda t: F.struct(*[_heuristic(t, p).alias(p) for p in FACTORS]))


def over_limit(tokens: Column, limit: int = CONTEXT_LIMIT) -> Column:
    return tokens > limit


def divergence(actual: Column, estimated: Column) -> Column:
    """Relative distance; 0 where there is no estimate."""
    return F.when(estimated > 0, F.abs(actual - estimated) / estimated).otherwise(0.0)


def last_estimate(c: Column, provider: str) -> Column:
    """The last estimate that a log holds, or null."""
    found = F.regexp_extract_all(text_of(c), F.lit(flagged(ESTIMATE, "i")), F.lit(1 if provider == "openai" else 2))
    return F.try_element_at(found, F.lit(-1)).cast("long")
