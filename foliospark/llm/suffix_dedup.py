"""Removal of repeated passages with a sparse suffix order, built by distributed prefix doubling.

A byte of a text goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id.
Whole suffix orders start with a rank for every byte and double the compared length from one; here the same doubling
starts at half the length, at sampled positions:

1. Rank at ``length // 2``. In each window of ``length`` bytes the half-length string with the smallest name (leftmost of
   equals) is the window's anchor. Equal windows have equal anchors at equal offsets, so ranking the anchors alone
   decides which windows can repeat; about two of 27 positions are anchors. Spark deals the named anchors to
   buckets, each bucket is sorted, and an anchor in a single document is unique and leaves.
2. The windows of one anchor form a run, and the name of the bytes that the run covers is sorted with the anchor's. A
   run that a smaller document has too is settled whole. A run that is alone under its anchor is unique and leaves.
3. Rank at ``length``. Runs that share their anchor but not all their bytes go on: each of their windows is ranked by the pair
   (rank at half the length here, rank at half the length one offset on), sorted as before. That is past the threshold.

A batch sends each name once, with its smallest document, and settles repeats within itself, so a passage that very many
documents hold costs a row a batch. Defined results: a null text is empty; a text shorter than ``length`` is kept; rows
with the same id don't take from each other; a row with a null id is kept whole and takes nothing from others; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Prefix, U, mix, pack, unpack
from .store import materialize, partitions

#: Text and rows of a batch, buckets for each shuffle partition, and text for a bucket: they bound what a worker holds.
BATCH_BYTES, BATCH_DOCS, SPREAD, BUCKET_BYTES = 8_000_000, 60_000, 4, 64_000_000
_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])
_REPLIES = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("names", pa.binary())])
_NAMES, _COVERED, _OPEN, _WINDOWS = 0, 1, 2, 3
#: Bytes of a name, and of a head within its bucket: with the bucket's own share that compares names at 95 bits from 128 buckets on.
WIDTH, HEAD = 6, 5


class Windows:
    """Anchors, runs and names of the windows of one text."""

    def __init__(self, text: bytes, length: int):
        data = np.frombuffer(text, np.uint8)
        self.length, self.half, self.count = length, length // 2, len(data) - length + 1
        self.prefix = Prefix(data)
        self.names = self.prefix.every(self.half)
        least, at, span = self.names, np.arange(len(self.names), dtype=np.int32), 1
        wide = length - self.half + 1
        while span < wide:
            step = min(span, wide - span)
            left = least[:-step] <= least[step:]
            at = np.where(left, at[:-step], at[step:])
            least = np.where(left, least[:-step], least[step:])
            span += step
        turns = np.flatnonzero(at[1:] != at[:-1]) + 1
        self.starts = np.concatenate([[0], turns])
        self.ends = np.concatenate([turns, [self.count]])
        self.anchors = least[self.starts]
        self.runs = self.prefix.window(self.starts, self.ends - 1 + length)

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the windows at ``at``: of the first half, and of both halves."""
        first, second = self.names[at], self.names[at + self.length - self.half]
        return first, mix(first + second * U(0x9FB21C651E98DF25))

    def positions(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of the windows of the chosen runs."""
        starts, sizes = self.starts[chosen], (self.ends - self.starts)[chosen]
        return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(starts) else np.zeros(0, np.int64)


def _low(names: np.ndarray) -> np.ndarray:
    return names & U((1 << (8 * WIDTH)) - 1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in batches of a bounded size, by id."""
    rows, size = [], 0
    for b in batches:
        columns = [b.column(k) for k in range(b.num_columns)]
        for i in range(b.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            rows.append(row)
            size += len(row[1] or "")
            if size >= BATCH_BYTES or len(rows) >= BATCH_DOCS:
                yield sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
                rows, size = [], 0
    if rows:
        yield sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])


def _by_doc(docs: np.ndarray, names: np.ndarray, kind: int) -> pa.RecordBatch:
    """One reply for each document, its names in one value."""
    by = np.argsort(docs, kind="stable")
    docs, names = docs[by], names[by]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    offsets = (np.append(starts, len(docs)) * WIDTH).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(pack(names, WIDTH)).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(docs[starts]), pa.array(np.full(len(starts), kind, np.int32)), values], schema=_REPLIES)


def _send(heads: list[np.ndarray], tails: list[np.ndarray], owners: list[np.ndarray], ids: np.ndarray, buckets: int, covered: int) -> Iterator[pa.RecordBatch]:
    """A batch's names to their buckets, each once with its smallest document; repeats in the batch are replied to at once."""
    if not heads:
        return
    head, tail, owner = np.concatenate(heads), np.concatenate(tails), np.concatenate(owners)
    both = mix(head + tail * U(0xA24BAED4963EE407))
    by = np.argsort(both, kind="stable")  # owners ascend, so the first of a name has the smallest id
    both, head, tail, owner = both[by], head[by], tail[by], owner[by]
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    first = np.repeat(owner[starts], np.diff(np.append(starts, len(both))))
    later = ids[owner] > ids[first]
    replies = _by_doc(ids[owner[later]], _low(tail[later]), covered)
    home = int(ids[0]) % buckets
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(replies), home, np.int32)), replies.column(1), replies.column(0), replies.column(2)], schema=_ROWS)
    head, tail, owner = head[starts], tail[starts], owner[starts]
    bucket = ((head >> U(32)) * U(buckets)) >> U(32)
    by = np.argsort((bucket << U(32)) | owner.astype(U), kind="stable")
    filled, at = np.unique(bucket[by], return_index=True)
    out = [_packed(ids, owner[part], head[part], tail[part]) for part in np.split(by, at[1:])]
    n = len(out)
    yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([_NAMES] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(out, pa.binary())], schema=_ROWS)


def _packed(ids: np.ndarray, owner: np.ndarray, head: np.ndarray, tail: np.ndarray) -> bytes:
    """Names of one bucket, by owner: counts, the owners' ids as the first and steps of as few bytes as they need, a bit for each name
    that begins another owner, then heads and tails. The bucket stands for a head's upper bits, so few of the others are kept."""
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    used = ids[owner[new]]
    steps = np.diff(used).astype(U)
    size = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    top = np.array([len(owner), len(used), size, used[0]], np.int64)
    return top.tobytes() + pack(steps, size).tobytes() + np.packbits(new).tobytes() + pack(head, HEAD).tobytes() + pack(tail, WIDTH).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, tails and ids of a part."""
    n, n_used, size, first = np.frombuffer(data, np.int64, 4).tolist()
    raw, sizes = np.frombuffer(data, np.uint8, offset=32), (size * (n_used - 1), -(-n // 8), HEAD * n)
    steps, new, head, tail = np.split(raw, np.cumsum(sizes))
    used = np.cumsum(np.concatenate([[first], unpack(steps.reshape(-1, size)).view(np.int64)]))
    return unpack(head.reshape(n, HEAD)), unpack(tail.reshape(n, WIDTH)), used[np.cumsum(np.unpackbits(new, count=n)) - 1]


def _sample(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> anchors and runs."""
    for rows in _batches(batches):
        heads, tails, owners = [], [], []
        for k, row in enumerate(rows):
            data = (row[1] or "").encode("utf-8", "surrogatepass")
            if len(data) >= length:
                w = Windows(data, length)
                heads.append(w.anchors)
                tails.append(w.runs)
                owners.append(np.full(len(w.runs), k, np.int64))
        yield from _send(heads, tails, owners, np.array([r[0] for r in rows], np.int64), buckets, _COVERED)


def _named(flags, kind: int) -> np.ndarray:
    found = [np.frombuffer(x["names"], np.uint8).reshape(-1, WIDTH) for x in flags or () if x["kind"] == kind]
    return unpack(np.concatenate(found)) if found else np.zeros(0, U)


def _refine(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, flags -> rank pairs of the windows of open runs."""
    for rows in _batches(batches):
        heads, tails, owners = [], [], []
        for k, (_, text, flags) in enumerate(rows):
            if len(wanted := _named(flags, _OPEN)):
                w = Windows((text or "").encode("utf-8", "surrogatepass"), length)
                at = w.positions(np.flatnonzero(np.isin(_low(w.runs), wanted)))
                head, tail = w.pairs(at)
                heads.append(head)
                tails.append(tail)
                owners.append(np.full(len(at), k, np.int64))
        yield from _send(heads, tails, owners, np.array([r[0] for r in rows], np.int64), buckets, _WINDOWS)


def _rank(table: pa.Table, covered: int, report_open: bool) -> pa.Table:
    """Sorts one bucket; replies to every document whose name a smaller one has, and to those that must go on."""
    out, heads, tails, docs = [], [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for kind, doc, data in zip(*(table.column(c).to_pylist() for c in ("kind", "doc_id", "payload")), strict=True):
        if kind != _NAMES:
            out.append((doc, kind, data))
            continue
        for found, part in zip((heads, tails, docs), _unpacked(data), strict=True):
            found.append(part)
    passed = pa.RecordBatch.from_pydict({k: [r[i] for r in out] for i, k in enumerate(_REPLIES.names)}, schema=_REPLIES)
    head, tail, doc = np.concatenate(heads), np.concatenate(tails), np.concatenate(docs)
    if not len(head):
        return pa.Table.from_batches([passed])
    by = np.lexsort((doc, tail, head))
    head, tail, doc = head[by], tail[by], doc[by]
    new_head = np.concatenate([[True], head[1:] != head[:-1]])
    new_tail = new_head | np.concatenate([[True], tail[1:] != tail[:-1]])
    least = doc[np.flatnonzero(new_tail)][np.cumsum(new_tail) - 1]
    later = doc > least
    replies = [passed, _by_doc(doc[later], tail[later], covered)]
    if report_open:
        several = np.add.reduceat(new_tail.astype(np.int64), np.flatnonzero(new_head)) > 1
        opened = ~later & several[np.cumsum(new_head) - 1]
        replies.append(_by_doc(doc[opened], tail[opened], _OPEN))
    return pa.Table.from_batches(replies)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, flags -> what is kept and where the removed spans lie."""
    for b in batches:
        ids, texts, all_flags = (b.column(k) for k in range(3))
        kept, sizes, spans = [], [], []
        for i in range(b.num_rows):
            data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
            flags = all_flags[i].as_py()
            sizes.append(len(data))
            runs, windows = _named(flags, _COVERED), _named(flags, _WINDOWS)
            if not len(runs) and not len(windows):
                kept.append(data)
                spans.append([])
                continue
            w = Windows(data, length)
            repeated = np.zeros(w.count, bool)
            repeated[w.positions(np.flatnonzero(np.isin(_low(w.runs), runs)))] = True
            if len(windows):
                at = w.positions(np.flatnonzero(np.isin(_low(w.runs), _named(flags, _OPEN))))
                repeated[at[np.isin(_low(w.pairs(at)[1]), windows)]] = True
            total = np.concatenate([[0], np.cumsum(repeated), np.full(length - 1, repeated.sum())])
            covered = total[1:] > np.concatenate([np.zeros(length - 1, np.int64), total[: w.count]])
            edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "removed"])


def _flags(replies: DataFrame) -> DataFrame:
    return replies.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "names")).alias("flags")).hint("shuffle_hash")


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``kept`` (binary) and ``removed`` (array<struct<start,end>>, bytes) of every document. Buckets hold
    the names of ``bucket_bytes`` of text, so a worker's share does not grow with the table; the result does not depend on them."""
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    least = SPREAD * partitions(docs.sparkSession)
    n_bytes = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(least, -(-n_bytes // bucket_bytes))

    def dealt(named: DataFrame) -> DataFrame:
        # more buckets than the session's partitions were meant for get partitions of their own
        return (named.repartition(-(-buckets // SPREAD), "bucket") if buckets > least else named).groupBy("bucket")

    rows = "bucket int, kind int, doc_id long, payload binary"
    replies = "doc_id long, kind int, names binary"

    def rank_runs(table: pa.Table) -> pa.Table:
        return _rank(table, _COVERED, True)

    def rank_windows(table: pa.Table) -> pa.Table:
        return _rank(table, _WINDOWS, False)

    first = materialize(dealt(mine.mapInArrow(partial(_sample, length=length, buckets=buckets), rows)).applyInArrow(rank_runs, replies))
    known = mine.join(_flags(first), "doc_id", "left")
    second = dealt(known.mapInArrow(partial(_refine, length=length, buckets=buckets), rows)).applyInArrow(rank_windows, replies)
    more = _flags(second).withColumnRenamed("flags", "more")
    none = F.array().cast("array<struct<kind:int,names:binary>>")
    flagged = known.join(more, "doc_id", "left").select("doc_id", "text", F.concat(F.coalesce("flags", none), F.coalesce("more", none)).alias("flags"))
    return flagged.mapInArrow(partial(_cut, length=length), "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")


def doubling_ranks(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``pos`` and ``least`` of the windows of ``length`` bytes that a smaller document has, by plain prefix doubling.

    Every byte gets a rank. In each round Spark sorts the pairs (rank here, rank ``offset`` on), and their places in that
    order are the next ranks, which stand for twice the bytes; positions whose pair is unique leave. The offset doubles until
    the ranks stand for ``length`` bytes, or no position is left. ``remove_repeats`` gives the same with sampled positions;
    this is the measure of what the whole order costs.
    """
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("b")).where("doc_id IS NOT NULL AND b IS NOT NULL")
    # a row has a document's bytes; its number tells rows with one id apart
    rows = materialize(mine.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(F.regexp_extract_all(F.hex("b"), F.lit(".."), F.lit(0)))).select("row", "doc_id", F.col("pos").cast("long").alias("pos"), F.conv("col", 16, 10).cast("long").alias("rank")))
    known = 1
    while known < length and not rows.isEmpty():
        offset = min(known, length - known)
        later = rows.select("row", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("next"))
        pairs = rows.join(later, ["row", "pos"])
        order = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").sort("rank", "next").withColumn("new", F.monotonically_increasing_id())
        rows, known = materialize(pairs.join(materialize(order.drop("n")), ["rank", "next"]).select("row", "doc_id", "pos", F.col("new").alias("rank"))), known + offset
    least = F.min("doc_id").over(Window.partitionBy("rank"))
    return rows.withColumn("least", least).where("least < doc_id").select("doc_id", "pos", "least")
