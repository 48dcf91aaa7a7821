"""Filter interaction audit: what every filter removes in every order, from counts of failure masks.

A document's mask has one bit for each filter that it fails. Documents are counted by part and mask; the subset-zeta
transform turns a part's counts into the survivors of every set of filters at once (those whose mask lies in the set's
complement). All else is a difference of neighbouring sets: what a step of an order removes is the survivors before it less
those after it, and the same counts restricted to good or toxic documents give what is lost of them. So a corpus is read
once, whatever the number of orders.

The filter for copies needs no join with its hot keys: the first holders of each text are matched by text and id,
they pass, and the failing ones are all others, by difference of counts.

Defined results: a null text is empty (no words, no characters); empty texts equal one another; a null part is the empty
string; a document without a label, or with null labels, is neither good nor toxic, and several labels of one id count
together (good if one of them is, toxic likewise); rows with the same ``doc_id`` count one by one, and have no
smaller id among themselves; a row without an id is no copy and no original; an empty table has no parts and no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: The filters by letter; the last one, identical texts, looks at the whole table.
NAMES = "ABCDE"
COUNTS = ("n", "good", "toxic")


def sign_failures(text: Column) -> Column:
    """Mask of the filters C and D: over 3 % capitals, holds a symbol."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def word_failures(text: bytes) -> int:
    """Mask of the filters A and B: under 200 words, under half of the words distinct."""
    words = text.split()  # of bytes: at the six ASCII gaps
    return (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, key, mask, text -> the same without the text, the mask with the filters on words."""
    for b in batches:
        found = [word_failures(t.as_buffer().to_pybytes()) for t in b.column(4)]
        mask = pc.add(b.column(3), pa.array(found, pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], mask], names=["doc_id", "part", "key", "mask"])


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row a document: ``doc_id``, ``part``, ``key`` (digest of the text), ``mask`` of A to D, ``good`` and ``toxic`` (0 or 1)."""
    t = F.coalesce(F.col(text), F.lit(""))
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("key"), sign_failures(t).alias("mask"), t.alias("text"))
    # a set of a text's words is several times cheaper in Python than Spark's split and distinct arrays
    mine = mine.mapInArrow(_add_words, "doc_id long, part string, key binary, mask int")
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    said = lambda c, to: F.coalesce(c, F.lit(0)).alias(to)
    return mine.join(known, "doc_id", "left").select("doc_id", "part", "key", "mask", said("quality", "good"), said("toxic", "toxic"))


def count_masks(rows: DataFrame, copies: int) -> DataFrame:
    """``part``, ``mask`` and ``COUNTS`` from rows of ``judge``; bit ``copies`` is set where a smaller id holds the text."""
    rows = materialize(rows)  # digests and numbers only: the texts are read once

    def counted(df: DataFrame, bit: int, sign: int) -> DataFrame:
        of = (F.lit(1), F.col("good"), F.col("toxic"))
        return df.groupBy("part", (F.col("mask") + bit).alias("mask")).agg(*[(F.sum(c) * sign).cast("long").alias(n) for c, n in zip(of, COUNTS, strict=True)])

    first = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    passed = rows.join(first, ["key", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL").select("key", "doc_id", "part", "mask", "good", "toxic"))
    # every row fails, but for those that pass
    parts = counted(rows, copies, 1).unionByName(counted(passed, copies, -1)).unionByName(counted(passed, 0, 1))
    return parts.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def zeta(counts: Column, k: int) -> Column:
    """Sums over subsets: element S becomes the sum of the elements whose number has no bit outside S."""
    def step(acc: Column, bit: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(acc, i.bitwiseXOR(bit))).otherwise(0))

    return F.aggregate(F.lit([1 << b for b in range(k)]), counts, step)


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """One row a part: for each of ``COUNTS`` an array by set of filters (as a number), how many no filter of it removes."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    # a part has at most 2^k masks
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("_m"))
    by_mask = lambda c: F.transform(every, lambda m: F.coalesce(F.try_element_at("_m", m)[c], F.lit(0).cast("long")))
    # a set's survivors lie in its complement, so the transform is read from its end
    return held.select("part", *[F.reverse(zeta(by_mask(c), k)).alias(c) for c in COUNTS])


def order_steps(alive: DataFrame, names: str = NAMES) -> DataFrame:
    """Every step of every order of the filters, for each part of ``survivors``.

    ``kept`` and ``removed`` tell what the step leaves and takes; ``redundant`` are those failing its filter that went earlier;
    ``unique_fails`` fail its filter only; ``good_lost`` and ``toxic_lost`` are labelled documents among the removed;
    ``shapley`` is what the filter removes summed over all orders.
    """
    k = len(names)
    full = (1 << k) - 1
    orders = F.lit(["".join(x) for x in permutations(names)])
    each = alive.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.get(F.lit([1 << b for b in range(k)]), F.instr(F.lit(names), x) - 1))
    bits = F.slice(bits, 1, k)
    each = each.withColumn("_bit", F.get(bits, F.col("step") - 1)).withColumn("_before", F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a.bitwiseOR(x)))
    before, bit = F.col("_before"), F.col("_bit")
    drop = lambda c, s: F.get(F.col(c), s) - F.get(F.col(c), s.bitwiseOR(bit))
    weights = F.lit([factorial(s) * factorial(k - 1 - s) for s in range(k)])
    share = F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(bit) == 0, F.get(weights, F.bit_count(s)) * drop("n", s)).otherwise(0))
    return each.select(
        "part", "filter_order", "step", F.get("n", before.bitwiseOR(bit)).alias("kept"), drop("n", before).alias("removed"),
        (drop("n", F.lit(0)) - drop("n", before)).alias("redundant"), drop("n", F.lit(full).bitwiseXOR(bit)).alias("unique_fails"),
        drop("good", before).alias("good_lost"), drop("toxic", before).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``order_steps`` of the five filters over ``docs``."""
    return order_steps(survivors(count_masks(judge(docs, labels, doc_id, text, part), copies=1 << (len(NAMES) - 1)), len(NAMES)))
