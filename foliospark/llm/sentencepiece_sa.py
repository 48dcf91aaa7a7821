"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that were not seen before are concatenated and indexed by a suffix array (sorted to the depth of two
eight-byte keys; longer pieces are compared in full). Every piece of the vocabulary is binary-searched for its range of
occurrences, and the ranges become edges (word, first byte, piece). The edges are sorted and relaxed over all words at
once: a word keeps its piece ends as bits, and an edge takes effect where both its ends are ends and one end lies
between, which then goes. For a BPE model the edges of a word are relaxed by score and then by position, which gives the
ids of the model's own encoder. Where that order could differ (a piece that can also arise from a part with a lower score,
at a place where it was not ready), the part is merged one by one.

A word above 63 bytes, as text without spaces has, falls into parts wherever no occurrence of a piece reaches across: no merge
can either. A part is a word of its own; one that is still longer keeps its ends as a linked list instead of bits, and
the edges of one piece are relaxed there at once. Occurrences are expanded a bounded number at a time, by score.

A word is a run of spaces and what follows up to the next space; no piece reaches across, which is checked on loading.
Characters without a piece become byte pieces. Decoding concatenates pieces, and drops the space put before each text.

Defined results: a null text has null ids, an empty one none; ``decode(encode(t))`` is ``t``, but that U+2581 comes back as
a space, as the model reads it; rows are encoded one by one, so repeated rows agree; other columns pass through, but for
``ids`` and ``n_tokens``, which are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words that a worker remembers and their characters, words indexed together, code points taken at once, bytes of a part
#: whose ends fit in one number, and occurrences expanded at once (but those of one piece).
CACHE_WORDS, CACHE_CHARS, INDEXED_WORDS, AT_ONCE, FIT, OCCURRENCES = 250_000, 8_000_000, 40_000, 1_500_000, 63, 2_000_000


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then from starts[1] on, and so forth."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)


class Vocabulary:
    """Pieces by id, with scores, as read from a model file."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: list[int]):
        bad = [p for i, p in enumerate(pieces) if i not in special and MARK in p.lstrip(MARK)]
        if bad or len(byte_ids) != 256:
            raise ValueError("pieces must not reach across spaces, and all bytes need pieces")
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        ranked = sorted(self.ids, key=lambda p: (-scores[self.ids[p]], self.ids[p]))
        self.rank = {p: k for k, p in enumerate(ranked)}
        self.many = [p for p in ranked if len(p) > 1]
        data = [p.encode() for p in self.many]
        self.sizes = np.array([len(x) for x in data], np.int64)
        self.many_ids = np.array([self.ids[p] for p in self.many], np.int32)
        self.ranks = np.array([self.rank[p] for p in self.many], np.int64)
        self.late = np.array([self._late(p) for p in self.many])
        self.data = data
        self.low, self.high = (np.array([[int.from_bytes(x[k : k + 8].ljust(8, fill), "big") for k in (0, 8)] for x in data], np.uint64).reshape(-1, 2) for fill in (b"\0", b"\xff"))
        shown = [p.replace(MARK, " ").encode() if i not in special else b"" for i, p in enumerate(pieces)]
        for byte, i in enumerate(byte_ids):
            shown[i] = bytes([byte])
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown_starts = np.concatenate([[0], np.cumsum(self.shown_sizes)[:-1]])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _late(self, piece: str) -> bool:
        """Whether the piece is the sum of two pieces (or characters) of which one has a lower score."""
        own = self.rank[piece]
        return any(max((self.rank[x] for x in (piece[:k], piece[k:]) if len(x) > 1 and x in self.rank), default=-1) > own and all(len(x) == 1 or x in self.rank for x in (piece[:k], piece[k:])) for k in range(1, len(piece)))


    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From ``vars`` of another one, without working it out again."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out


def load(model_file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    return Vocabulary(pieces, [model.get_score(i) for i in range(n)], special, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def merged(word: str, v: Vocabulary) -> list[int]:
    """Ids of one word: the best-scored pair of neighbours is joined until none is left; the first of equals."""
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if j < len(parts) and (r := v.rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [x for p in parts if p is not None for x in ([v.ids[p]] if p in v.ids else [int(v.byte_ids[b]) for b in p.encode()])]


class SuffixIndex:
    """Suffix array over the character starts of concatenated words; a zero byte ends each word."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        key = padded[: len(data) + 8].copy()
        for span in (1, 2, 4):  # doubling the packed length: 2, 4, 8 bytes
            key = (key << np.uint64(8 * span)) | np.concatenate([key[span:], np.zeros(span, np.uint64)])
        first, second = key[places], key[places + 8]
        order = np.argsort(first, kind="stable")
        tied = first[order]
        same = np.concatenate([[False], tied[1:] == tied[:-1]])
        block = np.cumsum(~same)
        again = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        if len(again):
            order[again] = order[again][np.lexsort((second[order[again]], block[again]))]
        self.data, self.places, self.first, self.second = data, places[order], first[order], second[order]

    def bounds(self, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Range of each piece of several characters in the suffix array (of its first 16 bytes)."""
        lo = np.searchsorted(self.first, v.low[:, 0], "left")
        hi = np.searchsorted(self.first, v.high[:, 0], "right")
        deep = np.flatnonzero(v.sizes > 8)
        for bound, side, out in ((v.low[deep, 1], "left", lo), (v.high[deep, 1], "right", hi)):
            a, b = lo[deep].copy() if side == "left" else begin, hi[deep].copy()
            if side == "left":
                begin = a.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                x = self.second[np.minimum(mid, len(self.second) - 1)]
                right = open_ & ((x < bound) if side == "left" else (x <= bound))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            out[deep] = a
        return lo, hi

    def occurrences(self, v: Vocabulary, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, piece number) of every occurrence of a piece of several characters; the best-scored pieces first."""
        total = np.cumsum(hi - lo)
        a = 0
        while a < len(lo):
            done = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + OCCURRENCES, "right")))
            size = hi[a:b] - lo[a:b]
            piece, place = np.repeat(np.arange(a, b), size), self.places[ranges(lo[a:b], size)]
            long = np.flatnonzero(v.sizes[piece] > 16)
            if len(long):
                keep = np.ones(len(piece), bool)
                keep[long] = [self.data[p : p + v.sizes[k]].tobytes() == v.data[k] for p, k in zip(place[long], piece[long], strict=True)]
                place, piece = place[keep], piece[keep]
            if len(piece):
                yield place, piece
            a = b


class Chain:
    """Piece ends of parts of any length, as a linked list over the bytes."""

    def __init__(self, at: np.ndarray, size: int):
        self.end, self.next = np.zeros(size + 1, bool), np.zeros(size + 1, np.int64)
        self.end[at] = True
        self.next[at[:-1]] = at[1:]

    def relax(self, place: np.ndarray, piece: np.ndarray, v: Vocabulary, token: np.ndarray) -> np.ndarray:
        """Edges by piece, best score first; returns places where a piece was not ready that may become so later."""
        by = np.lexsort((place, piece))
        place, piece = place[by], piece[by]
        cuts = np.concatenate([np.flatnonzero(np.diff(piece, prepend=-1)), [len(piece)]])
        doubt = [np.zeros(0, np.int64)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k, lo = piece[a], place[a:b]
            size = v.sizes[k]
            lo = lo[self.end[lo] & self.end[lo + size]]
            middle = self.next[lo]
            single = (middle < lo + size) & (self.next[middle] == lo + size)
            if v.late[k]:
                doubt.append(lo[(middle < lo + size) & ~single])
            lo, middle = lo[single], middle[single]
            # of a chain of overlapping ones every other takes effect: the one before has taken its start
            fresh = np.diff(lo, prepend=-size) >= size
            order = np.arange(len(lo))
            taken = (order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0
            lo, middle = lo[taken], middle[taken]
            self.end[middle] = False
            self.next[lo] = lo + size
            token[lo] = v.many_ids[k]
        return np.concatenate(doubt)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each has."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    word_size = np.array([len(x) for x in raw], np.int64)
    word_start = np.concatenate([[0], np.cumsum(word_size + 1)[:-1]])
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    inside = np.ones(len(data), bool)
    inside[word_start + word_size] = False
    places = np.flatnonzero(inside & ((data & 0xC0) != 0x80))
    # every character is a piece of its own at first
    width = np.diff(np.append(places, len(data)))
    width -= ~inside[places + width - 1]
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, which = np.unique(code, return_inverse=True)
    token = np.full(len(data), -1, np.int32)
    token[places] = np.array([v.ids.get(chr(c), -1) for c in letters], np.int32)[which]
    index = SuffixIndex(data, places)
    bounds = index.bounds(v)
    # words, of which long ones fall into parts
    heads = np.zeros(len(data), bool)
    heads[word_start] = True
    if (word_size > FIT).any():
        reach = np.zeros(len(data) + 1, np.int64)
        for place, piece in index.occurrences(v, *bounds):
            reach += np.bincount(place + 1, minlength=len(reach))
            reach -= np.bincount(place + v.sizes[piece], minlength=len(reach))
        apart = np.cumsum(reach)[places] == 0
        heads[places[apart & np.repeat(word_size > FIT, np.add.reduceat(inside & ((data & 0xC0) != 0x80), word_start))]] = True
    start = np.flatnonzero(heads)
    owner = np.cumsum(heads) - 1
    size = np.diff(np.append(start, len(data)))
    size -= ~inside[start + size - 1]
    ends = np.zeros(len(start), np.uint64)
    fits = size <= FIT
    offset = places - start[owner[places]]
    short = fits[owner[places]]
    np.add.at(ends, owner[places][short], np.uint64(1) << offset[short].astype(np.uint64))
    ends[fits] |= np.uint64(1) << size[fits].astype(np.uint64)
    slow, one = np.zeros(len(start), bool), np.uint64(1)
    chain = None if fits.all() else Chain(np.union1d(places[~short], (start + size)[~fits]), len(data))
    found = []
    for place, piece in index.occurrences(v, *bounds):
        far = ~fits[owner[place]]
        if far.any():
            slow[owner[chain.relax(place[far], piece[far], v, token)]] = True
        found.append((place[~far], piece[~far]))
    place, piece = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    word = owner[place]
    by = np.argsort((word << 22) | (v.ranks[piece] << 6) | (place - start[word]), kind="stable")
    word, place, piece = word[by], place[by], piece[by]
    many = np.bincount(word, minlength=len(start))
    at = np.concatenate([[0], np.cumsum(many)[:-1]])
    turn = np.argsort(-many, kind="stable")
    upto = np.searchsorted(-many[turn], -np.arange(many.max(initial=0)), "left")
    for k, n in enumerate(upto):
        mine = turn[:n]
        edge = at[mine] + k
        lo = (place[edge] - start[mine]).astype(np.uint64)
        hi = lo + v.sizes[piece[edge]].astype(np.uint64)
        now = ends[mine]
        between = ((one << hi) - one) & ~((one << (lo + one)) - one)
        inner = now & between
        bounded = ((now >> lo) & (now >> hi) & one).astype(bool)
        single = inner & (inner - one)
        ready = bounded & (inner != 0) & (single == 0)
        ends[mine[ready]] = now[ready] & ~between[ready]
        token[place[edge][ready]] = v.many_ids[piece[edge][ready]]
        slow[mine[bounded & (single != 0) & v.late[piece[edge]]]] = True
    # what starts at an end is a piece; a character without one gives its bytes
    started = np.zeros(len(places), bool)
    started[short] = ((ends[owner[places][short]] >> offset[short].astype(np.uint64)) & one).astype(bool)
    if chain:
        started[~short] = chain.end[places[~short]]
    started &= ~slow[owner[places]]
    known = started & (token[places] >= 0)
    spread = started & ~known
    counts = np.where(known, 1, np.where(spread, width, 0))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ids = np.zeros(int(counts.sum()), np.int32)
    ids[first[known]] = token[places[known]]
    ids[ranges(first[spread], counts[spread])] = v.byte_ids[data[ranges(places[spread], counts[spread])]]
    lengths = np.bincount(owner[places], weights=counts, minlength=len(start)).astype(np.int64)
    if slow.any():
        begin, out, last = np.concatenate([[0], np.cumsum(lengths)]), [], 0
        for k in np.flatnonzero(slow):
            one_by_one = merged(data[start[k] : start[k] + size[k]].tobytes().decode("utf-8", "surrogatepass"), v)
            out += [ids[last : begin[k]], np.array(one_by_one, np.int32)]
            lengths[k], last = len(one_by_one), begin[k]
        ids = np.concatenate([*out, ids[last:]])
    return ids, np.add.reduceat(lengths, owner[word_start]) if words else lengths


class Encoder:
    """Encodes batches; words met before are taken from memory."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        known, before, used, words = self.known, len(self.known), [], []
        for t in texts:
            mine = _WORDS.findall(MARK + t.replace(" ", MARK)) if t else []
            words.append(len(mine))
            used += [known.setdefault(w, len(known)) for w in mine]
        if len(known) > before:
            fresh = list(known)[before:]
            self.chars += sum(map(len, fresh))
            found = [encode_words(fresh[k : k + INDEXED_WORDS], self.v) for k in range(0, len(fresh), INDEXED_WORDS)]
            ids, sizes = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]])])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        at = np.array(used, np.int64)
        total = np.concatenate([[0], np.cumsum(self.sizes[at])])
        ends = total[np.cumsum(words)] if words else np.zeros(0, np.int64)
        return self.ids[ranges(self.starts[at], self.sizes[at])], np.diff(np.concatenate([[0], ends]))


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """Bytes of the text that ids stand for, without the space put before it."""
    out = v.shown[ranges(v.shown_starts[ids], v.shown_sizes[ids])].tobytes()
    return out[1:] if out[:1] == b" " else out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_file: str, text: str = "text", verify: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens``; with ``verify`` also ``round_trip``, found by decoding the ids in
    the same worker, so that no second one holds the texts."""
    docs = docs.drop("ids", "n_tokens", *(["round_trip"] if verify else []))
    at, names = docs.columns.index(text), [*docs.columns, "ids", "n_tokens", *(["round_trip"] if verify else [])]
    shared = docs.sparkSession.sparkContext.broadcast(vars(load(model_file)))  # the vocabulary file bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.of(shared.value))
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in _groups(texts):
                ids, sizes = encoder.encode([t or "" for t in texts[lo:hi]])
                gone = pa.array([t is None for t in texts[lo:hi]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids), mask=gone)
                part = b.slice(lo, hi - lo)
                added = [lists, pa.array(sizes)]
                if verify:
                    ends = np.cumsum(sizes)
                    same = [t is None or decode(ids[e - n : e], encoder.v) == t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t, e, n in zip(texts[lo:hi], ends, sizes, strict=True)]
                    added.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    fields = [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields + [T.StructField("round_trip", T.BooleanType())] * verify))


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in column ``to``; bytes that are no UTF-8 become U+FFFD."""
    df = df.drop(to)
    at, names = df.columns.index(ids), [*df.columns, to]
    v = load(model_file)
    shared = df.sparkSession.sparkContext.broadcast({k: vars(v)[k] for k in ("shown", "shown_starts", "shown_sizes")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(shared.value)
        for b in batches:
            column = b.column(at)
            out = [decode(x.values.to_numpy(zero_copy_only=False), v).decode("utf-8", "replace") if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def round_trip(df: DataFrame, text: str = "text", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``round_trip``: whether the decoded text is the text, U+2581 read as a space."""
    return df.withColumn("round_trip", F.translate(F.col(text), MARK, " ").eqNullSafe(F.col(decoded)))
