"""Line dedup by pairwise alignment.

Lines are named by a hash of their stripped text. Overlapping documents are found through names of telling lines (at
least ``min_words`` words, where two characters of a script without spaces between words count as one) and of runs: from each line that is not telling, the run back to the last telling line and the
run on to the next one. The holders of a name are tied to its first holder, the one with the smallest id, so a name costs
one pair a holder however many there are, also for a line that most documents hold. Each pair is aligned with patience
diff (lines that are unique in both anchor a longest increasing chain, and the stretches between are aligned in turn),
and the aligned common blocks with a telling line are deleted from the later document. What the alignment leaves of the
names that both have (repeated, or in another order) goes too.

So the result does not depend on which pairs are aligned: a line goes exactly where it lies in a run of lines, one of them
telling, that some earlier document has too. Each line of such a run has its telling line or its run to one as a name, the
run's holder has the name, and so has the name's first holder.

Defined results: a null text stays null, an empty one empty; blank lines are lines that are not telling; a document whose
last line goes has the text ''; of rows with the same id the one with the smallest line sequence stands for the id, and
only rows with its text are changed; a row with a null id is left alone; other columns pass through, whatever their names,
but ``n_lines`` and ``n_removed_lines``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Runs, U
from .store import materialize

BLANK = 0
#: Scripts that put no spaces between words.
UNSPACED = "".join(f"\\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def line_names(text: Column, min_words: int) -> Column:
    """Name of each line: 0 for a blank one, odd for a telling one, else even."""
    def name(x: Column) -> Column:
        bare = F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))
        spaced = bare.rlike("^(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]++){%d}[^\\x20\\x09-\\x0D]" % (min_words - 1))
        telling = spaced | bare.rlike("^(?:[^%s]*+[%s]){%d}" % (UNSPACED, UNSPACED, 2 * min_words))
        return F.when(bare == "", F.lit(BLANK).cast("long")).otherwise(F.xxhash64(bare).bitwiseAND(F.lit(-2)).bitwiseOR(telling.cast("long")))

    return F.transform(F.split(text, "\n", -1), name)


def _chain(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of (i, j), given by i, in which j grows too."""
    ends, tops, before = [], [], {}
    for i, j in places:
        k = bisect_left(ends, j)
        before[i, j] = tops[k - 1] if k else None
        if k == len(ends):
            ends.append(j)
            tops.append((i, j))
        else:
            ends[k], tops[k] = j, (i, j)
    out, at = [], tops[-1] if tops else None
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs of places of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _chain([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x != BLANK and in_a[x] == 1 and x in place])
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def run_names(lines: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line of texts that begin at ``begins`` (and end where the next one does), the names of the runs back to its
    text's last telling line and on to the next one, 0 where there is none."""
    names = lines.view(U)
    at, telling, runs = np.arange(len(names)), np.flatnonzero(names & U(1)), Runs(names)
    text = np.searchsorted(begins, at, "right") - 1
    out = []
    for near in (np.searchsorted(telling, at, "right") - 1, np.searchsorted(telling, at)):
        to = np.append(telling, -1)[near]
        good = np.flatnonzero((to >= begins[text]) & (to < begins[text + 1]))
        name = np.zeros(len(names), U)
        name[good] = runs.window(np.minimum(good, to[good]), np.maximum(good, to[good]) + 1)
        out.append(name)
    return out[0], out[1]


def _left_over(early: list[int], late: list[int], gone: set[int]) -> bool:
    """Whether ``late`` has a run of lines of ``early``, with a telling one, that is not all gone."""
    have, telling, left = set(early), False, False
    for j, x in enumerate(late):
        if x not in have:
            telling = left = False
            continue
        telling, left = telling or bool(x & 1), left or j not in gone
        if telling and left:
            return True
    return False


def common_blocks(early: list[int], late: list[int]) -> list[int]:
    """Places in ``late`` of the aligned blocks that have a telling line, and of what else has a name that ``early`` has."""
    out, block = set(), []
    for i, j in [*patience(early, late), (-1, -1)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if any(late[y] & 1 for _, y in block):
                out.update(y for _, y in block)
            block = []
        block.append((i, j))
    if _left_over(early, late, out):
        texts = [np.array(x, np.int64) for x in (late, early)]
        for mine, other in zip(*(run_names(x, np.array([0, len(x)])) for x in texts), strict=True):
            out.update(np.flatnonzero(np.isin(mine, other) & (mine != 0)).tolist())
    return sorted(out)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = [common_blocks(early, late) for early, late in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "gone"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and places of lines that go, in any order and repeated -> whether each line up to the last of them stays, and how many go."""
    for b in batches:
        masks, counts = [], []
        for row in b.column(1):
            gone = row.values.to_numpy(zero_copy_only=False)
            masks.append(np.ones(gone.max() + 1, bool))
            masks[-1][gone] = False
            counts.append(len(masks[-1]) - int(masks[-1].sum()))
        ends = np.cumsum([0, *map(len, masks)]).astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(masks) if masks else np.zeros(0, bool)))
        yield pa.RecordBatch.from_arrays([b.column(0), kept, pa.array(counts, pa.int64())], names=["doc_id", "kept", "n_gone"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lines -> doc_id and each name that ties it."""
    for b in batches:
        lists = b.column(1)
        begins = lists.offsets.to_numpy().astype(np.int64)
        lines = lists.values.slice(begins[0], begins[-1] - begins[0]).to_numpy()
        begins = begins - begins[0]
        docs = np.repeat(b.column(0).to_numpy(), np.diff(begins))
        back, on = run_names(lines, begins)
        # of a telling line the two runs are one
        found = np.concatenate([np.stack([docs, back.view(np.int64)], 1)[back != 0], np.stack([docs, on.view(np.int64)], 1)[(on != 0) & (on != back)]])
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["doc_id", "line"])


def overlaps(lines: DataFrame) -> DataFrame:
    """Pairs (doc_id, early) of documents tied through a name, from ``doc_id`` and ``lines``."""
    each = lines.where(F.exists("lines", lambda x: x.bitwiseAND(F.lit(1)) == 1)).select("doc_id", "lines").mapInArrow(_names, "doc_id long, line long")
    held = materialize(each.groupBy("line").agg(F.min("doc_id").alias("early"), F.max("doc_id").alias("last")).where("early < last"))
    return each.join(held, "line").where("early < doc_id").select("doc_id", "early").distinct()


def drop_common_blocks(docs: DataFrame, min_words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the common blocks gone from ``text``, and ``n_lines`` and ``n_removed_lines``."""
    named = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.struct(line_names(F.col(text), min_words).alias("lines"), F.xxhash64(text).alias("whole")).alias("_s"))
    lines = materialize(named.groupBy("doc_id").agg(F.min("_s").alias("_s")).select("doc_id", "_s.lines", "_s.whole"))
    pairs = overlaps(lines)
    late = lines.select("doc_id", F.col("lines").alias("late"))
    early = lines.select(F.col("doc_id").alias("early"), F.col("lines").alias("first"))
    # tables on both sides: a document with very many later partners is split like any skewed key
    pairs = materialize(pairs).join(early, "early").select("doc_id", "first")
    aligned = materialize(pairs).join(late, "doc_id").select("doc_id", "first", "late").mapInArrow(_align, "doc_id long, gone array<int>")
    gone = materialize(aligned.where(F.size("gone") > 0).groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone")).mapInArrow(_kept, "doc_id long, kept array<boolean>, n_gone long"))
    gone = gone.join(lines, "doc_id").select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"), "kept", "n_gone").hint("shuffle_hash")
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_whole"))
    out = keyed.join(gone, ["_id", "_whole"], "left")
    whole = F.col("_doc")[text]
    parts = F.split(whole, "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: F.coalesce(F.get("kept", i), F.lit(True))), "\n")
    counts = {"n_lines": F.when(whole.isNull(), 0).otherwise(F.size(parts)).cast("long"), "n_removed_lines": F.coalesce("n_gone", F.lit(0).cast("long"))}
    columns = [F.when(F.col("n_gone").isNull(), whole).otherwise(left).alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns if c not in counts]
    return out.select(*columns, *[v.alias(k) for k, v in counts.items()])
