"""Language identification by rank-order profiles.

A text's letters are lower-cased and counted as n-grams of one to three letters within words, a blank standing at either end
of a word. The most frequent n-grams, by rank, are its profile; a language's profile is that of all its labelled texts
together. A text gets the language at the smallest out-of-place distance: the sum, over the text's n-grams, of how far each
one's rank is from its rank in the language, or the profile size where the language lacks it.

Learning counts n-grams over all labelled texts: partial counts a worker, then one aggregation by language and n-gram.
Profiles go to the workers in blocks of at most ``BLOCK`` languages (300 numbers each), and texts pass the blocks one after
the other, so what is broadcast has a fixed bound and any number of languages is taken.

Defined results: an n-gram is one 64-bit number (three code points of 21 bits), so different ones never meet; equal counts
rank by that number, equal distances by the language's name; combining marks belong to words but are no letters; a text
that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned; languages whose texts
have no letters are not learned; the score is one less the distance's share of its maximum; very long texts are counted in
pieces; rows are judged one by one, so repeated rows agree; other columns pass through, but ``lang_pred`` and ``score``,
which are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize

#: N-grams of a profile.
SIZE = 300
BLOCK = 1000
#: Code points counted at a time, and n-grams a worker holds before it sends its partial counts.
PIECE, HELD = 1 << 20, 1 << 20
#: Stands for a blank in an n-gram; no letter has this code point, and 0 would make a shorter n-gram of it.
BLANK = 1


def kinds() -> np.ndarray:
    """For every code point 0, or 1 for a combining mark, or 2 for a letter."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x110000)], np.uint8)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of n-grams with summed counts."""
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    sums = np.zeros(len(grams), np.int64)
    np.add.at(sums, at, np.concatenate([c for _, c in parts]))
    return grams, sums


def gram_counts(text: str | None, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a text as packed code points, and their counts; nothing if it has no letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return none
    kind = kinds[points]
    if not (kind == 2).any():
        return none
    # one blank stands for what is between words, and at both ends
    inside = kind > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    line = np.concatenate([[BLANK], np.where(inside, points, BLANK)[keep], [BLANK]]).astype(np.int64)
    parts = []
    for lo in range(0, len(line), PIECE):
        a = line[lo : lo + PIECE + 2]
        own = min(PIECE, len(line) - lo)  # n-grams that start in the piece
        one, two, three = a[:own], a[1 : own + 1], a[2 : own + 2]
        head, middle = one[: len(two)], two[: len(three)]
        grams = [one[one > BLANK], ((head << 21) | two)[(head > BLANK) | (two > BLANK)], ((one[: len(three)] << 42) | (middle << 21) | three)[middle > BLANK]]
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
    return _merged(parts)


def top(grams: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams in the order of their rank."""
    if len(grams) > 4 * size:  # all that tie with the last one stay in
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """lang, text -> partial counts by language and n-gram."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            grams, counts = gram_counts(t.as_py(), shared.value)
            if len(grams):
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
            if size > HELD:
                for lang, parts in held.items():
                    held[lang] = [_merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from flush()
                    size = 0
    yield from flush()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """``lang``, ``gram`` and ``rank`` (from 0) of the profiles, from all rows whose text and language are not null."""
    mine = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(kinds())
    counts = mine.mapInArrow(partial(_count, shared=shared), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Spark keeps the first rows of each partition before the shuffle, so a language's many rare n-grams stay where they are
    return materialize(counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank"))


def tables(rows: list, size: int = SIZE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all their n-grams, and the rank of each n-gram in each language (``size`` where it lacks it)."""
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(langs), len(grams)), size, np.int32)
    place = {x: k for k, x in enumerate(langs)}
    for r in rows:
        ranks[place[r["lang"]], np.searchsorted(grams, r["gram"])] = r["rank"]
    return langs, grams, ranks


def nearest(profile: np.ndarray, known: np.ndarray, ranks: np.ndarray, size: int = SIZE) -> tuple[int, int]:
    """Index of the language at the smallest distance (ties: the first), and that distance."""
    at = np.minimum(np.searchsorted(known, profile), len(known) - 1)
    hit = known[at] == profile
    far = np.abs(ranks[:, at[hit]] - np.flatnonzero(hit)[None, :].astype(np.int32))
    far[ranks[:, at[hit]] == size] = size
    distance = far.sum(1) + size * int((~hit).sum())
    k = int(np.argmin(distance))
    return k, int(distance[k])


def _judge(batches: Iterator[pa.RecordBatch], shared, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Adds the best language of a block, unless the row brings one that is at least as near."""
    kinds, langs, known, ranks = shared.value
    for b in batches:
        best, score = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        for i, t in enumerate(b.column(at)):
            profile = top(*gram_counts(t.as_py(), kinds), size)
            if len(profile):
                k, distance = nearest(profile, known, ranks, size)
                mine = 1.0 - distance / (len(profile) * size)
                if best[i] == UNKNOWN or mine > score[i]:
                    best[i], score[i] = langs[k], mine
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=b.schema.names)


UNKNOWN = "und"


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1)."""
    out = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    at = out.columns.index(text)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    last = None
    while True:  # blocks in the order of names, so the first of equal distances stays
        names = profiles.select("lang").distinct()
        block = [r["lang"] for r in (names if last is None else names.where(F.col("lang") > last)).orderBy("lang").limit(BLOCK).collect()]
        if not block:
            return out
        # at most BLOCK * size rows, and a byte for each code point
        rows = profiles.where(F.col("lang").between(block[0], block[-1])).collect()
        shared = docs.sparkSession.sparkContext.broadcast((kinds(), *tables(rows, size)))
        out, last = out.mapInArrow(partial(_judge, shared=shared, at=at, size=size), schema), block[-1]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: its id's checksum leaves 1 by three; a null id never is."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
