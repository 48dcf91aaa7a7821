"""Periodic run detection over words, by Lyndon roots.

A run is a stretch of words with a smallest period q that no neighbouring word extends. Every run has, under an order of
the words or under its reverse, a start from which one period is the longest Lyndon word. So a stack of Lyndon words scanned
from right to left, once under each order, names every run: where it compares the suffixes at i and j, which start a Lyndon
word and the one after it, their common extension tells how far the period j - i goes on, and the extension to the left
gives the run's start. Extensions compare words one by one at first and then by binary search over rolling hashes modulo a
prime; what hashes call equal is then compared word by word, and only the part of a stretch that was not compared before.

Words that occur too seldom in a text to be part of a run of the asked power cut it into pieces that are scanned one
by one, which loses no run.

Defined results: words are maximal runs of characters other than tab to carriage return and space, compared as
bytes; a null text has no words and no runs, and its collapsed text is empty; rows are handled one by one, so repeated rows
agree; texts of any length are taken whole, in memory that grows with the text (some 100 bytes a word); columns but the
id and the text are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIME, _BASE = (1 << 61) - 1, 0x1F3A5B7C9D2E4F61 % ((1 << 61) - 1)
#: So many words are compared one by one before hashes are asked.
NEAR = 12
_powers = array("Q", [1])

Run = tuple[int, int, int]


def _power(n: int) -> array:
    while len(_powers) <= n:
        _powers.append(_powers[-1] * _BASE % _PRIME)
    return _powers


class Stretches:
    """Common extensions of positions i < j of a sequence of positive numbers; ``words`` has one more element, 0, at its end."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words) - 1
        self.sums = self.plain = None
        #: For a distance, the last stretch that has it as a period: start, and the first position that breaks it.
        self.known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the k words from i hash like those from j."""
        s, p = self.sums, self.powers[k]
        return (s[i + k] - s[i] * p - s[j + k] + s[j] * p) % _PRIME == 0

    def _prepare(self) -> None:
        if self.sums is None:
            self.sums = array("Q", accumulate(self.words, lambda h, x: (h * _BASE + x + 1) % _PRIME, initial=0))
            self.powers = _power(len(self.words))
            self.plain = np.array(self.words, np.int64)

    def _longest(self, least: int, most: int, same) -> int:
        """Largest k of least..most with ``same(k)``, which holds up to some k and not beyond."""
        step = max(NEAR, 1)
        while least < most and same(min(least + step, most)):
            least = min(least + step, most)
            step *= 2
        most = min(least + step, most)
        while least < most:
            k = (least + most + 1) // 2
            if same(k):
                least = k
            else:
                most = k - 1
        return least

    def _proved(self, i: int, j: int, k: int) -> int:
        """k if the k words from i are those from j, else how many of them are."""
        a, b = self.plain[i : i + k], self.plain[j : j + k]
        return k if np.array_equal(a, b) else int(np.argmin(a == b))

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on."""
        w, d = self.words, j - i
        low, end = self.known.get(d, (0, -1))
        if low <= i < end - d:
            return end - j
        k = 0
        while k < NEAR and w[i + k] == w[j + k]:
            k += 1
            if i + k == low and low < end - d:  # from here on the stretch is known
                self.known[d] = (i, end)
                return end - j
        if k < NEAR:
            return k
        self._prepare()
        joins = i < low < end - d
        most = low - i if joins else self.n - j
        k = self._proved(i, j, self._longest(k, most, lambda k: self._same(i, j, k)))
        stop = end if joins and k == most else j + k
        self.known[d] = (i, stop)
        return stop - j

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j."""
        w, k = self.words, 0
        most = i
        while k < min(most, NEAR) and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < NEAR or k == most:
            return k
        self._prepare()
        k = self._longest(k, most, lambda k: self._same(i - k, j - k, k))
        a, b = self.plain[i - k : i], self.plain[j - k : j]
        return k if np.array_equal(a, b) else int(np.argmin((a == b)[::-1]))


def _scan(words: list[int], least: int, power: int, found: set[Run]) -> None:
    """Adds the runs whose root is the longest Lyndon word at its start under the order of the numbers."""
    n = len(words) - 1
    stretches, last = Stretches(words), {}
    after = [0] * n  # where the longest Lyndon word at a position ends
    for i in range(n - 1, -1, -1):
        a, j, same = words[i], i + 1, 0
        while j < n:
            b = words[j]
            if a == b:
                same = stretches.ahead(i, j)
                if words[i + same] > words[j + same]:
                    break
                same = 0
            elif a > b:
                break
            j = after[j]
        after[i] = j
        q = j - i
        if same >= (power - 2) * q and same:
            start, end = last.get(q, (n, -1))
            if start <= i and end == j + same:
                continue
            start, end = i - stretches.behind(i, j), j + same
            last[q] = (start, end)
            if end - start >= max(least, power * q):
                found.add((start, end - start, q))


def find_runs(words: list, least: int = 6, power: int = 4) -> list[Run]:
    """(start, length, period) of the runs of at least ``least`` words and ``power`` (2 or more) periods, by start, then period."""
    names: dict = {}
    ids = np.array([names.setdefault(x, len(names) + 1) for x in words], np.int64)
    # a word of such a run occurs once in each of its periods
    often = np.bincount(ids, minlength=1)[ids] >= power if len(ids) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    found: set[Run] = set()
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if hi - lo >= least:
            piece = ids[lo:hi]
            here: set[Run] = set()
            # the 0 at the end is below all words under the first order, and above all under the second
            _scan([*piece.tolist(), 0], least, power, here)
            _scan([*(-piece).tolist(), 0], least, power, here)
            found.update((lo + s, size, q) for s, size, q in here)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when of every run only its first period does."""
    edges = np.zeros(n + 1, np.int64)
    for start, size, q in runs:
        edges[start + q] += 1
        edges[start + size] -= 1
    return np.cumsum(edges)[:n] == 0


def _detect(batches: Iterator[pa.RecordBatch], least: int, power: int) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "runs", "collapsed"]
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        sizes, runs, texts = [], [], []
        for t in b.column(1):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: at the six ASCII gaps
            found = find_runs(words, least, power)
            if found:
                words_left = [words[k] for k in np.flatnonzero(kept_words(len(words), found)).tolist()]
            else:
                words_left = words
            sizes.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(words_left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, run), pa.array(texts, pa.string())], names=["doc_id", *names])


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (array<struct<start,length,period>>, by start, then period) and ``collapsed``: the text's
    words joined by one space, of every run only the first period."""
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mine.mapInArrow(partial(_detect, least=least, power=power), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: str) -> Column:
    """The run of greatest length; of equal ones the smallest start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, best)


def with_planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where, of every document whose id's checksum is divisible by ten, the words from one place on
    repeat: word i >= a becomes word a + (i - a) % p, with a, p and the choice given by crc32 of the decimal id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")
    g, n = F.floor(h / 10), F.size("_w")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    word = lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))).cast("int"))
    chosen = docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("_w")).select("doc_id", "text", "_w", F.when(n > 0, a).alias("_a"), F.when(n > 0, p).alias("_p"))
    changed = F.array_join(F.transform("_w", lambda _, i: word(i)), " ")
    return chosen.select("doc_id", F.when(F.col("_p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Digests of ``periodic_runs``: how many runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = longest("runs")
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("_b.n")
    return out.select("doc_id", "n_runs", F.col("_b.start").alias("start"), length.alias("length"), F.col("_b.period").alias("period"), F.expr("-_b.n * 1000 div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
