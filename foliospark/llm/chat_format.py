"""Cumulative-snapshot collapse of logged conversations, then chat rendering.

A logger that writes a conversation again after every exchange leaves many snapshots, each a prefix of the next.
Every conversation gets a rolling hash for each of its turn prefixes; a conversation whose whole hash is a proper
prefix hash of another one is dropped by an anti-join, and of equal conversations the smallest ``conv_id`` stays.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows count as turns; a null role or
text differs from an empty one for the comparison and is rendered as empty; rows with a null ``conv_id`` belong to no
conversation and are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _cell(c: Column) -> Column:
    """Null, and text with its length, so that no two turns are written alike."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, and ``turns`` in order."""
    return (
        turns.select("conv_id", F.struct("turn", "role", "text").alias("_t"))
        .where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("_t")).alias("turns"))
    )


def prefix_hashes(turns: str = "turns") -> Column:
    """The rolling hash after each turn, in order."""
    own = F.transform(turns, lambda t: F.md5(F.concat(_cell(t["role"]), F.lit("|"), _cell(t["text"]))))
    none = F.array().cast("array<string>")
    return F.aggregate(own, none, lambda acc, h: F.array_append(acc, F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), h), 256)))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` of every conversation that is no proper prefix of another one and no later copy of an equal one."""
    hashed = conversations(turns).select("conv_id", prefix_hashes().alias("_p"))
    whole = hashed.groupBy(F.element_at("_p", -1).alias("_h")).agg(F.min("conv_id").alias("conv_id"))
    # distinct before the join: neither side then has a key twice, however often a conversation was logged
    shorter = hashed.select(F.explode(F.slice("_p", F.lit(1), F.size("_p") - 1)).alias("_h")).distinct()
    return whole.join(shorter, "_h", "left_anti").select("conv_id")


def render(turns: str = "turns") -> Column:
    """The chat text of one conversation."""
    none = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], none), F.lit("\n"), F.coalesce(t["text"], none), F.lit(CLOSE))), "")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of the maximal conversations."""
    kept = maximal_conversations(turns)
    return conversations(turns).join(kept, "conv_id", "left_semi").select("conv_id", F.size("turns").cast("long").alias("n_turns"), render().alias("rendered"))
