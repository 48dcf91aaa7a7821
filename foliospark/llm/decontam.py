"""Benchmark decontamination: CGK random walks, bit sampling over repeated walks, exact edit verification.

Texts and items are sequences of words (lower-cased, punctuation at the ends dropped). A CGK walk reads a sequence from
some start and, at each step, stays or moves on by a coin that the step and the word under it give. Two sequences that
differ by few edits see the same words at most steps, so edit distance becomes Hamming distance. A key is a walk's words at
a few sampled steps. Walks start at every word of a text and of every item (so at every place of an item-sized window), and
a walk with other coins and other sampled steps is one repetition. Equal keys make candidates.

How many walks an item needs is worked out for its length and for ``max_share``, by trials on made-up sequences with as
many edits as the item may have, half of them placed at random and half evenly, which leaves the shortest clean
runs; the larger number counts. An item of so few words that ``max_share`` allows no edit has its whole word sequence
as its key. An item for which ``MOST_WALKS`` don't reach ``recall`` is cut into one piece more than it may have edits, one
of which always stands unchanged. So items of every length are found.

Each candidate is checked exactly: the least word edit distance between the whole item and any part of the text around
the place (Sellers' algorithm on Myers' bit vectors), at most ``max_share`` of the item's words.

Items are dealt by hash into twice as many blocks as ``block_items`` rows or ``block_words`` words a block ask for, and each block is
broadcast, so its size is bounded on average, beside one item; every block runs over all texts. Keys that very many items share
give hits that are taken some at a time, and an item's rarest words then tell which of them can be one. Defined results: a null or empty text
or item matches nothing; an empty item table finds nothing; equal items are each reported; one row for each ``doc_id`` and
``item_id``, the nearest, whether documents or items repeat an id; null ids are left out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Prefix, U, mix, word_bounds

#: Bytes that are part of words: letters, digits and all of multi-byte characters.
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words of a piece that are named; a longer one is found by its first words.
PIECE_WORDS = 8
#: Texts, or characters of texts, searched together; a longer text is searched alone.
AT_ONCE, CHARS_AT_ONCE = 512, 2_000_000
#: Hits that are held at a time.
HITS = 2_000_000
#: Sampled steps of a walk lie one to three steps apart; a key of n words is taken from the first n + 1 samples.
GAPS, MOST_SAMPLES = (1, 2, 3), 6
MOST_WALKS, TRIALS = 32, 200
#: Items of more words need no more walks than items of this many.
LONG = 40


def words_of(text: str | None) -> np.ndarray:
    """Names of the words, without punctuation at their ends; words of punctuation only are left out."""
    return words_of_all([text])[0][:-1]


def words_of_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text followed by the empty word 0, and where each text begins (and the last ends)."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded), np.uint8)
    starts, ends = word_bounds(data)
    # a word begins at its first byte that is no punctuation and ends after its last one
    core = _CORE[data]
    before = np.concatenate([[0], np.cumsum(core, dtype=np.int64)])
    has = before[starts] < before[ends]
    starts, ends, at = starts[has], ends[has], np.flatnonzero(core)
    starts, ends = at[before[starts]], at[before[ends] - 1] + 1
    text_ends = np.cumsum([len(x) + 1 for x in encoded])
    upto = np.searchsorted(starts, text_ends)
    words = np.zeros(len(starts) + len(texts), U)
    words[np.arange(len(starts)) + np.searchsorted(text_ends, starts, "right")] = Prefix(data, True).window(starts, ends)
    return words, np.concatenate([[0], upto + np.arange(1, len(texts) + 1)])


def run_keys(words: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` words."""
    n = max(0, len(words) - length + 1)
    key = np.full(n, length, U)
    for k in range(length):
        key = mix(key ^ words[k : k + n]) * U(0x9FB21C651E98DF25)
    return key


def pieces(n_words: int, most: int) -> list[tuple[int, int]]:
    """Starts and named lengths of ``most`` + 1 pieces of an item: that many edits leave one of them unchanged."""
    bounds = [k * n_words // (most + 1) for k in range(most + 2)]
    return [(a, min(b - a, PIECE_WORDS)) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def sampled_steps(walk: int) -> list[int]:
    """The steps of a walk whose words make its keys."""
    gaps = np.random.default_rng(walk).choice(GAPS, MOST_SAMPLES - 1)
    return [0, *np.cumsum(gaps).tolist()]


def walk_keys(words: np.ndarray, walk: int, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, keys, places of the samples) of the walk from every word, for each size of key, smallest first."""
    steps, n = sampled_steps(walk), len(words)
    # a walk may run past the end, where only the empty word is
    words = np.concatenate([words, np.zeros(steps[-1] + 1, U)])
    coins = ((words ^ U(walk + 1)) * U(0xC2B2AE3D27D4EB4F)) >> U(40)
    at, step, places = np.arange(n), 0, []
    key = np.zeros(n, U)
    for k, sample in enumerate(steps):
        for step in range(step, sample):
            at = at + ((coins.take(at) >> U(step)) & U(1)).view(np.int64)
        step = sample
        key = key * U(0x9FB21C651E98DF25) + words.take(at)
        places.append(at)
        if k in sizes:
            yield k, key + U(walk), places
        if k >= max(sizes):
            return


def key_size(n_words: int, most: int) -> int:
    """Words of an item's keys: as many as the mean clean run has, so that edits leave some, from one to four."""
    return max(1, min(MOST_SAMPLES - 2, n_words // (most + 1)))


def item_keys(words: np.ndarray, walk: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and starts of the walks that stay inside the item and see enough different words."""
    _, key, places = next(walk_keys(words, walk, {size}))
    good = np.flatnonzero((places[-1] < len(words)) & (_different(places) >= size))
    return key[good], good


def _different(places: list[np.ndarray]) -> np.ndarray:
    """How many of a walk's samples are of different places."""
    return 1 + sum((b > a).astype(np.int64) for a, b in zip(places, places[1:], strict=False))


def _edited(n_words: int, most: int, even: bool, rng: np.random.Generator) -> np.ndarray:
    """The words 1 to ``n_words`` with ``most`` edits."""
    places = [(k + 1) * n_words // (most + 1) for k in range(most)] if even else sorted(rng.choice(n_words, most, replace=False).tolist())
    out = list(range(1, n_words + 1))
    for place in reversed(places):
        new = int(rng.integers(1 << 20, 1 << 40))
        out[place : place + 1] = ([new], [], [new, out[place]])[int(rng.integers(3))]
    return np.array(out, U)


def walks_needed(n_words: int, most: int, recall: float) -> int | None:
    """Walks that find ``recall`` of the items of this length with ``most`` edits; None where ``MOST_WALKS`` don't."""
    size, worst = key_size(n_words, most), 0
    for even in (False, True):
        rng = np.random.default_rng(n_words)
        # every trial has words of its own
        firsts, gap = np.full(TRIALS, MOST_WALKS), np.zeros(1, U)
        own = [np.arange(1, n_words + 1).astype(U), *(_edited(n_words, most, even, rng) for _ in range(TRIALS))]
        salt = [mix(np.array([t + 1], U)) for t in range(TRIALS)]
        item = np.concatenate([x for t in range(TRIALS) for x in (mix(own[0] ^ salt[t]), gap)])
        text = np.concatenate([x for t in range(TRIALS) for x in (mix(own[t + 1] ^ salt[t]), gap)])
        item_of, ends = np.repeat(np.arange(TRIALS), n_words + 1), np.arange(1, TRIALS + 1) * (n_words + 1) - 1
        for walk in range(MOST_WALKS):
            (_, want, places), (_, have, _) = next(walk_keys(item, walk, {size})), next(walk_keys(text, walk, {size}))
            inside = (_different(places) >= size) & (ends[item_of] > places[-1])
            found = item_of[inside & np.isin(want, have)]
            firsts[found] = np.minimum(firsts[found], walk)
            if (firsts < MOST_WALKS).mean() >= recall:
                worst = max(worst, walk + 1)
                break
        else:
            return None
    return worst


def edit_hits(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of ``text`` nearest to the whole item, the first of equals; None above ``most``."""
    m = len(item)
    masks: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item.tolist()):
        masks[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, w in enumerate(text.tolist(), 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j)
    return best


class _Keys:
    """Sorted keys with their items and offsets, and one bit of 2^20 a key, which spares most texts' keys the search."""

    def __init__(self, found: list[tuple[np.ndarray, int, np.ndarray]]):
        key = np.concatenate([f[0] for f in found])
        owner, offset = np.repeat([f[1] for f in found], [len(f[0]) for f in found]), np.concatenate([f[2] for f in found])
        by = np.argsort(key, kind="stable")
        self.key, self.owner, self.offset = key[by], owner[by], offset[by]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(key >> U(44)).astype(np.int64)] = True

    def hits(self, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``mine``, items and offsets of all equal keys, some ``HITS`` at a time."""
        at = np.flatnonzero(self.seen[(mine >> U(44)).astype(np.int64)])
        lo = np.searchsorted(self.key, mine[at])
        many = np.searchsorted(self.key, mine[at], "right") - lo
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        ends = np.cumsum(many)
        begin = 0
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + HITS, "right")))
            n = many[begin:end]
            each = np.repeat(lo[begin:end] - (ends[begin:end] - n - done), n) + np.arange(n.sum())
            yield np.repeat(at[begin:end], n), self.owner[each], self.offset[each]
            begin = end


class _Anchors:
    """Where items can lie in a text by their rarest words: of any ``most`` + 1 words of an item one stands unchanged in a part of
    the text that is within ``most`` edits of it. Items with a common word only, whose places would be more than ``HITS``
    together, are not bound by it."""

    def __init__(self, index: ItemIndex, words: np.ndarray):
        self.reach, self.span = 2 * np.array(index.most, np.int64) + 8, np.int64(len(words) + index.longest + 1)
        owner, offset, word = index.anchors
        by = np.argsort(words, kind="stable")
        ordered = words[by]
        lo = np.searchsorted(ordered, word)
        many = np.searchsorted(ordered, word, "right") - lo
        of = np.bincount(owner, many, len(self.reach)).astype(np.int64)
        rank = np.argsort(of, kind="stable")
        self.free = np.zeros(len(of), bool)
        self.free[rank[np.cumsum(of[rank]) > HITS]] = True
        bound = ~self.free[owner]
        owner, offset, lo, many = owner[bound], offset[bound], lo[bound], many[bound]
        each = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else lo
        # where the whole item would begin; before the text's first word for some
        self.starts = np.unique(np.repeat(owner, many) * self.span + by[each] - np.repeat(offset, many) + index.longest)
        self.shift = index.longest

    def meet(self, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the item can lie at about ``start``."""
        place = owner * self.span + start + self.shift
        at = np.searchsorted(self.starts, place - self.reach[owner])
        found = np.zeros(len(place), bool)
        inside = at < len(self.starts)
        found[inside] = self.starts[at[inside]] <= (place + self.reach[owner])[inside]
        return found | self.free[owner]


def walks_by_length(items: list[tuple[int, str]], max_share: float, recall: float) -> dict[int, int | None]:
    """``walks_needed`` for the lengths of these items, those above ``LONG`` counting as that; None for no edits."""
    lengths = {min(len(words_of(t)), LONG) for _, t in items}
    return {n: walks_needed(n, most, recall) if (most := int(max_share * n)) else None for n in sorted(lengths)}


class ItemIndex:
    """Keys of one block of items: of walks, and of pieces where walks don't serve."""

    def __init__(self, items: list[tuple[int, str]], max_share: float, walks: dict[int, int | None]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.most = [int(max_share * len(w)) for w in self.words]
        self.sets = [frozenset(w.tolist()) for w in self.words]
        cut, walked = defaultdict(list), defaultdict(list)
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            n = min(len(w), LONG)
            if walks[n] is None:
                for start, length in pieces(len(w), self.most[k]):
                    cut[length].append((run_keys(w[start : start + length], length), k, np.array([start])))
                continue
            size = key_size(n, int(max_share * n))
            for walk in range(walks[n]):
                key, start = item_keys(w, walk, size)
                walked[walk, size].append((key, k, start))
        # for each item the places of its rarest words, one more than it may have edits
        self.longest = max((len(w) for w in self.words), default=0)
        names, counts = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True) if self.words else (np.zeros(0, U), np.zeros(0, np.int64))
        rare = [np.argsort(counts[np.searchsorted(names, w)], kind="stable")[: m + 1] for w, m in zip(self.words, self.most, strict=True)]
        self.anchors = np.repeat(np.arange(len(rare)), [len(r) for r in rare]), np.concatenate([*rare, np.zeros(0, np.int64)]), np.concatenate([*(w[r] for w, r in zip(self.words, rare, strict=True)), np.zeros(0, U)])
        self.runs = {length: _Keys(found) for length, found in sorted(cut.items())}
        self.walks: dict[int, dict[int, _Keys]] = defaultdict(dict)
        for (walk, size), found in sorted(walked.items()):
            self.walks[walk][size] = _Keys(found)

    def _hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for length, keys in self.runs.items():
            yield from keys.hits(run_keys(words, length))
        for walk, sizes in self.walks.items():
            for size, key, _ in walk_keys(words, walk, set(sizes)):
                yield from sizes[size].hits(key)

    def _candidates(self, words: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
        """(text, item, place in eighths) of the hits; nearby alignments of one item are one. Where items share their keys, so that
        hits are very many, their rarest words decide which are kept, and what is still too much comes in several parts."""
        near, held, anchors = [], 0, None
        for at, owner, offset in self._hits(words):
            start = at - offset
            if anchors is not None:
                kept = anchors.meet(owner, start)
                at, owner, start = at[kept], owner[kept], start[kept]
            doc = np.searchsorted(begins, at, "right") - 1
            near.append(np.unique(np.stack([doc, owner, (start - begins[doc]) // 8], 1), axis=0))
            held += len(near[-1])
            if held <= HITS:
                continue
            near = [np.unique(np.concatenate(near), axis=0)]
            if anchors is None:
                anchors = _Anchors(self, words)
                one = near[0]
                near = [one[anchors.meet(one[:, 1], begins[one[:, 0]] + one[:, 2] * 8)]]
            held = len(near[0])
            if held > HITS // 2:
                yield near[0]
                near, held = [], 0
        if near:
            yield np.unique(np.concatenate(near), axis=0)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item, distance, words of the item, first word, end word) of each item's nearest part in each text."""
        words, begins = words_of_all(texts)
        best: dict[tuple[int, int], tuple] = {}
        for part in self._candidates(words, begins):
            for d, k, place in part.tolist():
                self._check(words, begins, d, k, place, best)
        yield from (found for _, found in best.values())

    def _check(self, words: np.ndarray, begins: np.ndarray, d: int, k: int, place: int, best: dict[tuple[int, int], tuple]) -> None:
        """Keeps the nearest part at a place, if it is nearer than what is known, or as near and earlier."""
        item, most = self.words[k], self.most[k]
        lo = max(0, place * 8 - most)
        part = words[begins[d] + lo : max(begins[d], min(begins[d + 1] - 1, begins[d] + place * 8 + 8 + len(item) + most))]
        # each word that the part lacks is an edit
        if len(self.sets[k].difference(part.tolist())) > most:
            return
        hit = edit_hits(item, part, most)
        if hit and ((d, k) not in best or (hit[0], place) < best[d, k][0]):
            best[d, k] = (hit[0], place), (d, self.ids[k], hit[0], len(item), max(0, lo + hit[1] - len(item) - hit[0]), lo + hit[1])


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of a bounded size, each with the number of its first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and (k - at == AT_ONCE or size + len(t or "") > CHARS_AT_ONCE):
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t or "")
    if at < len(texts):
        yield at, texts[at:]


def find_items(docs: DataFrame, items: DataFrame, max_share: float = 0.2, recall: float = 0.99, block_items: int = 20_000, block_words: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``n_words``, ``first_word``, ``end_word``: one row for each item that a text holds."""
    spark = docs.sparkSession
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    places = ["distance", "n_words", "first_word", "end_word"]
    names = ["doc_id", "item_id", *places]

    def search(block: DataFrame) -> DataFrame:
        # at most block_items rows and block_words words, which bounds what is sent
        rows = sorted((r[0], r[1]) for r in block.collect())
        shared, walks = spark.sparkContext.broadcast(rows), walks_by_length(rows, max_share, recall)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, max_share, walks)
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                rows = [(ids[n + k].as_py(), i, d, m, lo, hi) for n, part in _parts(texts) for k, i, d, m, lo, hi in index.search(part)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=names)

        return mine.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    # items are dealt by hash into twice the blocks they would fill, so that none holds more than its share
    n, n_words = asked.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4).first()
    blocks = max(math.ceil(n / block_items), math.ceil(n_words / block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))
    found = search(asked) if blocks <= 1 else reduce(DataFrame.unionByName, [search(asked.where(part == k)) for k in range(2 * blocks)])
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct(*places)).alias("_near")).select("doc_id", "item_id", *[F.col(f"_near.{p}").alias(p) for p in places])


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_items``, ``item_ids`` and ``least_distance`` of the documents that hold an item."""
    return find_items(docs, items, **options).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("distance").alias("least_distance"))
