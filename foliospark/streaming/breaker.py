"""Circuit breaker of endpoints, worked out from the outcomes of their calls.

An endpoint opens at the ``failures``-th failure in a row and stays open until ``cool`` after its last failure; a later failure
while it is open puts that off. A success closes it at once and ends the row of failures. After the cool-down it closes by itself,
but the row of failures goes on, so one more failure opens it again.

Calls are rows (endpoint, ts, ok, call_id), taken in the order of (ts, call_id); a call whose outcome is null is left out. The
result are the changes: (endpoint, ts, state, reason), where reason is ``failures``, ``success`` or ``cool-down``.

``changes`` is the batch form, in windows. ``streamed`` keeps a few numbers an endpoint as state and closes it by a
timer. In a stream a call counts as late, and is dropped, if its time is before the watermark or before a call of its
endpoint that an earlier micro-batch has brought; an endpoint whose cool-down ends after the last watermark stays open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "endpoint string, at long, state string, reason string"


def _calls(calls: DataFrame) -> DataFrame:
    return calls.where("ok IS NOT NULL AND endpoint IS NOT NULL AND ts IS NOT NULL").select(F.col("endpoint").cast("string").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), "ok", F.col("call_id").cast("long").alias("call_id"))


def changes(calls: DataFrame, failures: int = 3, cool_seconds: int = 60) -> DataFrame:
    """Changes of every endpoint over all calls."""
    order = Window.partitionBy("endpoint").orderBy("at", "call_id")
    each = _calls(calls).withColumn("at", F.unix_micros("ts"))
    each = each.withColumn("_k", F.row_number().over(order))
    # failures in a row are counted from the last success
    began = F.max(F.when(F.col("ok"), F.col("_k"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("_streak", F.when(F.col("ok"), 0).otherwise(F.col("_k") - F.coalesce(began, F.lit(0))))
    each = each.withColumns({"_before": F.lag("at").over(order), "_next": F.lead("at").over(order), "_next_ok": F.lead("ok").over(order)})
    hot, cool = F.col("_streak") >= failures, F.lit(cool_seconds * 1_000_000)
    opens = hot & ((F.col("_streak") == failures) | (F.col("at") > F.col("_before") + cool))
    until = F.col("at") + cool
    cooled = hot & (F.col("_next").isNull() | (F.col("_next") > until))
    cured = hot & F.coalesce(F.col("_next_ok") & (F.col("_next") <= until), F.lit(False))
    made = lambda when, at, state, reason: F.when(when, F.struct(at.alias("at"), F.lit(state).alias("state"), F.lit(reason).alias("reason")))
    out = F.array_compact(F.array(made(opens, F.col("at"), "open", "failures"), made(cooled, until, "closed", "cool-down"), made(cured, F.col("_next"), "closed", "success")))
    return each.select("endpoint", F.explode(out).alias("_c")).select("endpoint", F.timestamp_micros("_c.at").alias("ts"), "_c.state", "_c.reason")


def streamed(calls: DataFrame, failures: int = 3, cool_seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Changes of every endpoint of a stream, as they are known."""
    cool = cool_seconds * 1_000_000

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # failures in a row, end of the cool-down (0: closed), and the last call
        streak, until, last, last_id = state.get if state.exists else (0, 0, -(1 << 62), 0)
        out = []
        if state.hasTimedOut:
            out.append((until, "closed", "cool-down"))
            until = 0
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "call_id"])
            for at, call, ok in zip(rows["at"].tolist(), rows["call_id"].tolist(), rows["ok"].tolist()):
                if (at, call) < (last, last_id):
                    continue
                last, last_id = at, call
                if until and at > until:
                    out.append((until, "closed", "cool-down"))
                    until = 0
                if ok:
                    if until:
                        out.append((at, "closed", "success"))
                    streak = until = 0
                else:
                    streak += 1
                    if streak >= failures:
                        if not until:
                            out.append((at, "open", "failures"))
                        until = at + cool
        seen = state.getCurrentWatermarkMs()
        if until and until // 1000 < seen:
            out.append((until, "closed", "cool-down"))
            until = 0
        state.update((streak, until, last, last_id))
        if until:
            state.setTimeoutTimestamp(max(until // 1000, seen + 1))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["endpoint", "at", "state", "reason"])

    rows = _calls(calls).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    found = rows.groupBy("endpoint").applyInPandasWithState(follow, SCHEMA, "streak long, until long, last long, last_id long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("endpoint", F.timestamp_micros("at").alias("ts"), "state", "reason")
