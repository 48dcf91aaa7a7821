"""N-gram Jaccard join with a prefix tree, and the groups of documents it links.

Every document is the set of its distinct word n-grams. Two documents link when the Jaccard similarity of their sets
reaches the threshold, compared in whole numbers. The join runs in three steps:

1. Blocks. The hash range is cut into more parts than two linked sets can differ in n-grams, so some parts are equal in
   both. A document is named under the cuts of its own size class and the next larger one (linked sets lie in one class
   or two adjacent ones). Documents that share a name are tied to the smallest of them, and the components of these ties
   are blocks: no link runs between two blocks. Small parts are shared by unrelated documents, so a set names its largest
   parts only: one more than it can differ in from any set that it links with, and all of the same count as the least of
   them. Of two linked sets take the one whose least count is higher. It leaves so few parts out that one of the equal
   ones is named, and the other set names that part too, so no link is missed.
2. Prefix tree. All n-grams have one global order: by how often their cell of a count sketch (``CELLS`` cells over the
   whole corpus) was met, most first, then by hash. The ordered sets are stored in a tree with compressed paths. Each set
   walks the tree before it is added: sets below a node share the overlap counted so far, and a subtree is left when even
   all remaining n-grams can't give the overlap that its set sizes need, or when all of it is already in the walker's
   group. A block is dealt into cells by size class: the tree of a cell holds one class, and the sets of that class and
   of the next one walk it, as linked sets lie in the same or adjacent classes. A class of more than ``CELL_NGRAMS``
   is cut into several trees, and the walks of several trees are tasks of their own.
3. Components over the links found.

Equal sets stand for one another: only the one with the smallest id is a member of a block. Defined results: a null or
empty text, or one without words, has the empty set, links with nothing and is its own group; a text with fewer than n
words has one n-gram, the whole sequence; rows with the same id count as one vertex with the smallest set (by size, then
hash); a null id is left out; ids may be any 64-bit number; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import U, mix, pack, shingle_set, unpack, word_hashes
from .store import materialize, partitions

#: n-grams that one tree may hold; cells of the count sketch, a fixed number whatever the input.
CELL_NGRAMS, CELLS = 1_000_000, 1 << 18
#: Parts beyond the differences that two sets of a class can have, as a share of these.
SPARE_PARTS = 0.15
BATCH_BYTES = 24_000_000
#: Bytes of text whose names go in one bucket, bytes of sets that go in one bin, and slices of the sketch at most.
BUCKET_BYTES, BIN_BYTES, SLICES = 64_000_000, 64_000_000, 64
_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_LINKS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in "abcde")])
_NAMES, _SETS, _COUNTS = 0, 1, 2


def set_of(text: str | None, n: int) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode("utf-8", "surrogatepass")), n)


def overlap_needed(sizes: int, num: int, den: int) -> int:
    """Least intersection of two sets with ``sizes`` elements together whose similarity is num/den."""
    return -(-num * sizes // (num + den))


def _class_ends(upto: int, num: int, den: int) -> list[int]:
    """First sizes of the classes: a set and the largest one that links with it lie in one class or two adjacent ones."""
    ends = [1]
    while ends[-1] <= upto:
        ends.append((ends[-1] - 1) * den // num + 1 if ends[-1] > 1 else 2)
        if ends[-1] <= ends[-2]:
            ends[-1] = ends[-2] + 1
    return ends


def part_names(grams: np.ndarray, num: int, den: int, firsts: list[int]) -> np.ndarray:
    """Names of the largest parts of a set under its two cuts."""
    size = len(grams)
    own = int(np.searchsorted(firsts, size, "right")) - 1
    out = []
    for c in (own, own + 1):
        top = firsts[c + 1] - 1
        differ = (2 * top) * (den - num) // (num + den)
        parts = differ + 1 + math.ceil(SPARE_PARTS * differ)
        cuts = np.searchsorted(grams, np.arange(1, parts, dtype=U) * U(2**64 // parts)) if parts > 1 else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], cuts, [size]])
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams * U(0xA24BAED4963EE407)))])
        counts = bounds[1:] - bounds[:-1]
        names = mix(sums[bounds[1:]] - sums[bounds[:-1]] + counts.astype(U) * U(0x9FB21C651E98DF25) + mix(np.arange(parts, dtype=U) + U(c) * U(1 << 40)))
        # most differences from a set that links with this one: it has at most size * den / num n-grams, and at most top
        most = (size + min(top, size * den // num)) * (den - num) // (num + den)
        out.append(names[counts >= np.partition(counts, parts - most - 1)[parts - most - 1]])
    return np.concatenate(out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= BATCH_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> U(46)).astype(np.int64)


def whole_name(grams: np.ndarray) -> np.ndarray:
    """128 bits that name a set."""
    return mix(np.array([grams.sum(dtype=U) + U(len(grams)), np.bitwise_xor.reduce(mix(grams))], U))


def _name_parts(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each batch: names of parts by bucket, the counts of the sketch's cells, and size, class and hash of every set."""
    firsts = _class_ends(1 << 12, num, den)
    slices = np.linspace(0, CELLS, min(buckets, SLICES) + 1).astype(np.int64)
    for ids, texts in _batches(batches):
        order = np.argsort(ids, kind="stable")
        seen: set[bytes] = set()
        sets, names, owners = np.zeros((len(ids), 4), np.int64), [], []
        counts = np.zeros(CELLS, np.uint32)
        for at, i in enumerate(order):
            grams = set_of(texts[i], n)
            if not len(grams):
                continue
            np.add.at(counts, cell_of(grams), np.uint32(1))
            whole = whole_name(grams)
            while firsts[-1] <= len(grams) or firsts[-2] <= len(grams):
                firsts = _class_ends(2 * firsts[-1], num, den)
            sets[at] = len(grams), np.searchsorted(firsts, len(grams), "right") - 1, *whole.view(np.int64)
            if whole.tobytes() in seen:
                continue
            seen.add(whole.tobytes())
            part = np.unique(part_names(grams, num, den, firsts))
            names.append(part)
            owners.append(np.full(len(part), at, np.int64))
        ids = ids[order]
        out = [(int(ids[0]) % buckets, _SETS, np.concatenate([ids[:, None], sets], 1).tobytes())]
        met = np.flatnonzero(counts)
        for k, (lo, hi) in enumerate(pairwise(np.searchsorted(met, slices))):
            if lo < hi:
                out.append((k, _COUNTS, np.stack([met[lo:hi].astype(np.uint32), counts[met[lo:hi]]]).tobytes()))
        if names:
            name, owner = np.concatenate(names), np.concatenate(owners)
            by = np.argsort(name, kind="stable")
            name, owner = name[by], owner[by]
            bucket = ((name >> U(32)) * U(buckets)) >> U(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[k], cuts[k + 1]
                used, local = np.unique(owner[lo:hi], return_inverse=True)
                head = np.array([len(used)], np.int64).tobytes() + ids[used].tobytes()
                rows = np.concatenate([pack(name[lo:hi], 8), pack(local.astype(U), 3)], 1)
                out.append((k, _NAMES, head + rows.tobytes()))
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(_ROWS.names)}, schema=_ROWS)


def _tie(table: pa.Table) -> pa.Table:
    """One bucket: ties every document of a name to the smallest, adds up its cells' counts; sets pass."""
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    found, names, docs, counts = [np.zeros((0, 6), np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)], np.zeros(CELLS, np.int64)

    def add(kind: int, *columns: np.ndarray) -> None:
        rows = np.zeros((len(columns[0]), 6), np.int64)
        rows[:, 0] = kind
        for k, c in enumerate(columns, 1):
            rows[:, k] = c
        found.append(rows)

    for kind, data in zip(kinds, payloads, strict=True):
        if kind == _SETS:
            add(kind, *np.frombuffer(data, np.int64).reshape(-1, 5).T)
        elif kind == _COUNTS:
            cell, more = np.frombuffer(data, np.uint32).reshape(2, -1)
            counts[cell] += more
        else:
            n = int(np.frombuffer(data, np.int64, 1)[0])
            ids = np.frombuffer(data, np.int64, n, 8)
            rows = np.frombuffer(data, np.uint8, offset=8 + 8 * n).reshape(-1, 11)
            names.append(unpack(rows[:, :8]))
            docs.append(ids[unpack(rows[:, 8:]).astype(np.int64)])
    met = np.flatnonzero(counts)
    add(_COUNTS, met, counts[met])
    name, doc = np.concatenate(names), np.concatenate(docs)
    if len(name):
        by = np.lexsort((doc, name))
        name, doc = name[by], doc[by]
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(name))))
        far = doc != least
        if far.any():
            add(_NAMES, *np.unique(np.stack([doc[far], least[far]], 1), axis=0).T)
    rows = np.concatenate(found)
    return pa.Table.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(rows[:, k]) for k in range(1, 6))], schema=_LINKS)


class _Node:
    __slots__ = ("path", "below", "here", "least", "most")

    def __init__(self, path: list[int], size: int):
        self.path, self.below, self.here, self.least, self.most = path, {}, [], size, size


class PrefixTree:
    """Ordered sets of one block; ``add`` returns, for each group that a set links with, one linked member."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.root, self.group = num, den, _Node([], 0), {}
        self.root.least, self.root.most = 1 << 60, 0

    def find(self, x: int) -> int:
        while self.group[x] != x:
            self.group[x] = self.group[self.group[x]]
            x = self.group[x]
        return x

    def links(self, mine: int, grams: list[int]) -> list[int]:
        """Walks the tree with a set, and joins its group with that of each set found."""
        self.group.setdefault(mine, mine)
        have, size, found = set(grams), len(grams), []
        place = {g: k for k, g in enumerate(grams)}
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, depth, overlap, used = stack.pop()
            path = node.path
            depth += len(path)
            if path:
                hits = [g for g in path if g in have]
                overlap += len(hits)
                if hits:
                    used = place[hits[-1]] + 1
                else:
                    last = path[-1]
                    while used < size and grams[used] < last:
                        used += 1
            rest = size - used
            best = min(max(depth + rest, node.least), node.most)
            if overlap + min(rest, best - depth) < overlap_needed(size + best, self.num, self.den) or self._all_mine(node, mine):
                continue
            if node.here and overlap >= overlap_needed(size + depth, self.num, self.den):
                for other in node.here:
                    if self.find(other) != self.find(mine):
                        found.append(other)
                        self.group[self.find(other)] = self.find(mine)
            stack.extend((child, depth, overlap, used) for child in node.below.values())
        return found

    def _all_mine(self, node: _Node, mine: int) -> bool:
        """Whether a leaf holds only sets of the walker's group; then it can add nothing."""
        return bool(node.here) and not node.below and all(self.find(x) == self.find(mine) for x in node.here)

    def add(self, mine: int, grams: list[int]) -> None:
        self.group.setdefault(mine, mine)
        node, k, size = self.root, 0, len(grams)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if k == size:
                node.here.append(mine)
                return
            child = node.below.get(grams[k])
            if child is None:
                child = node.below[grams[k]] = _Node(grams[k:], size)
                child.here.append(mine)
                return
            path, shared = child.path, 0
            while shared < len(path) and k + shared < size and path[shared] == grams[k + shared]:
                shared += 1
            if shared < len(path):
                upper = _Node(path[:shared], child.least)
                upper.most, upper.below[path[shared]] = child.most, child
                child.path = path[shared:]
                node.below[grams[k]] = upper
                child = upper
            node, k = child, k + shared


def join_cell(tree: dict[int, np.ndarray], walkers: dict[int, np.ndarray], home: bool, num: int, den: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the cell's links connect: between walkers and the tree's sets, and inside the tree if it is at ``home``."""
    sets = tree | walkers
    if not sets:
        return []
    grams = np.unique(np.concatenate(list(sets.values())))
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -counts[cell_of(grams)]))] = np.arange(len(grams))
    ordered = {i: np.sort(rank[np.searchsorted(grams, s)]).tolist() for i, s in sets.items()}

    def close(ids) -> list[int]:
        """Close sizes and equal beginnings next to each other: groups grow early, and the walks find them."""
        return sorted(ids, key=lambda i: (-len(ordered[i]), ordered[i][:8], i))

    held, out = PrefixTree(num, den), []
    for i in close(tree):
        if home:
            out += [(i, other) for other in held.links(i, ordered[i])]
        held.add(i, ordered[i])
    for i in close(walkers):
        out += [(i, other) for other in held.links(i, ordered[i])]
    return out


def trees_of(chunk: int, below: int, own: int, above: int) -> list[tuple[int, int, int, bool]]:
    """(class relative to the set's, chunk of the tree, task of the tree, whether the set is in the tree) for a set of
    ``chunk``, where its class and the ones below and above have so many chunks. A tree is at home in task 0, which
    the next class's chunk 0 walks too; other chunks of its class walk it in tasks 1 on, other chunks of the next class in -1 on."""
    out = [(0, chunk, 0, True)]
    out += [(0, chunk, other, True) for other in range(chunk + 1, own)] + [(0, other, chunk, False) for other in range(chunk)]
    out += [(0, chunk, -other, True) for other in range(1, above)]
    return out + [(-1, other, -chunk, False) for other in range(below)]


def _sets(batches: Iterator[pa.RecordBatch], n: int, bins: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, block, class, chunks of three classes, hash of the set that counts for the id -> one row for each task that needs the set."""
    schema = pa.schema([("bin", pa.int32()), ("block", pa.int64()), ("class", pa.int64()), ("chunk", pa.int32()), ("task", pa.int32()), ("inside", pa.bool_()), ("doc_id", pa.int64()), ("grams", pa.binary())])
    for b in batches:
        out = []
        for doc, text, block, size_class, below, own, above, h, i in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
            grams = set_of(text, n)
            if not len(grams) or whole_name(grams).view(np.int64).tolist() != [h, i]:
                continue
            data = grams.tobytes()
            mine = int(mix(np.array([doc], np.int64).view(U))[0] % U(own))
            for step, chunk, task, inside in trees_of(mine, below, own, above):
                key = mix(np.array([block, size_class + step, chunk, task], np.int64).view(U))
                at = int(mix(key * np.array([1, 3, 5, 7], U)).sum(dtype=U) % U(bins))
                out.append((at, block, size_class + step, chunk, task, inside, doc, data))
        yield pa.RecordBatch.from_pydict({k: [r[x] for r in out] for x, k in enumerate(schema.names)}, schema=schema)


def _join_bin(table: pa.Table, num: int, den: int, counts: np.ndarray) -> pa.Table:
    cells: dict[tuple, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    for block, size_class, chunk, task, inside, doc, data in zip(*(table.column(k).to_pylist() for k in ("block", "class", "chunk", "task", "inside", "doc_id", "grams")), strict=True):
        cells[block, size_class, chunk, task][0 if inside else 1][doc] = np.frombuffer(data, U)
    found = [link for key, (tree, walkers) in sorted(cells.items()) for link in join_cell(tree, walkers, key[3] == 0, num, den, counts)]
    return pa.Table.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _dealt(rows: DataFrame, key: str, many: int) -> GroupedData:
    """``rows`` by ``key``, of which there are ``many``: more than the session's partitions were meant for get partitions of their own."""
    return (rows.repartition(many, key) if many > partitions(rows.sparkSession) else rows).groupBy(key)


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every document. Buckets hold the names
    of ``bucket_bytes`` of text and bins ``bin_bytes`` of sets, so a worker's share does not grow with the table; the result does
    not depend on them."""
    spark = docs.sparkSession
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    buckets = max(partitions(spark), -(-(mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    named = mine.mapInArrow(partial(_name_parts, n=n, num=num, den=den, buckets=buckets), "bucket int, kind int, payload binary")
    ties = materialize(_dealt(named, "bucket", buckets).applyInArrow(_tie, "kind int, a long, b long, c long, d long, e long"))
    # at most CELLS numbers
    sketch = ties.where(f"kind = {_COUNTS}").select("a", "b").toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[sketch.column("a").to_numpy()] = sketch.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    sets = materialize(ties.where(f"kind = {_SETS}").groupBy(F.col("a").alias("doc_id")).agg(F.min(F.struct("b", "c", "d", "e")).alias("s")).select("doc_id", F.col("s.b").alias("n_shingles"), F.col("s.c").alias("class"), F.col("s.d").alias("h"), F.col("s.e").alias("i")))
    first = materialize(sets.where("n_shingles > 0").groupBy("h", "i").agg(F.min("doc_id").alias("first")))
    blocks = components(ties.where(f"kind = {_NAMES}").select("a", "b")).withColumnsRenamed({"v": "doc_id", "root": "block"})
    blocks = materialize(blocks.join(sets.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi"), "doc_id").select("doc_id", "block", "class", "n_shingles", "h", "i"))
    cells = blocks.groupBy("block", "class").agg(F.ceil(F.sum("n_shingles") / F.lit(CELL_NGRAMS)).cast("int").alias("own"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("grams"))
    near = Window.partitionBy("block").orderBy("class")
    beside = lambda f, step: F.when(f("class").over(near) == F.col("class") + step, f("own").over(near)).otherwise(0)
    cells = cells.select("block", "class", "own", "n", "grams", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above")).where("n > 1 OR below > 0 OR above > 0")
    cells = materialize(cells.drop("n"))
    # a set goes to as many trees as ``trees_of`` lists, with 8 bytes an n-gram
    sent = cells.agg(F.sum(8 * F.col("grams") * (F.col("own") + F.greatest(F.col("above") - 1, F.lit(0)) + F.col("below")))).first()[0] or 0
    bins = max(partitions(spark), -(-sent // bin_bytes))
    members = blocks.join(cells.drop("grams"), ["block", "class"])
    rows = mine.join(materialize(members).hint("merge"), "doc_id").select("doc_id", "text", "block", "class", "below", "own", "above", "h", "i").mapInArrow(partial(_sets, n=n, bins=bins), "bin int, block long, class long, chunk int, task int, inside boolean, doc_id long, grams binary")

    def join_bin(table: pa.Table) -> pa.Table:
        return _join_bin(table, num, den, shared.value)

    linked = _dealt(rows, "bin", bins).applyInArrow(join_bin, "a long, b long")
    groups = materialize(components(linked).withColumnsRenamed({"v": "first", "root": "component_id"}))
    of = first.join(groups, "first", "left").select("h", "i", F.coalesce("component_id", "first").alias("component_id"))
    return sets.join(materialize(of), ["h", "i"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
