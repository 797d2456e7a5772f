"""Lifecycle of scans as a keyed state: the first terminal event is final."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docrisk.operators.lifecycle import TERMINAL

OUTPUT = "scan_id bigint, state string, final_seq bigint"
STATE = "state string, final_seq bigint"
_TIMED_OUT = -1  # final_seq of a scan that ended by time


def _fold(timeout_ms: int | None, marker_ms: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan_id = key[0]
        if state.hasTimedOut:
            known, final = state.get
            if known in TERMINAL:  # the marker has served its time
                state.remove()
                return
            # The time-out is an end like any other: it stays as a marker, so a late end does not open the scan again.
            state.update(("failed", _TIMED_OUT))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + marker_ms)
            yield _row(scan_id, "failed", None)
            return
        known, final = state.get if state.exists else (None, None)
        if final == _TIMED_OUT:
            return
        before = (known, final)
        latest = None
        for chunk in chunks:  # bounded Arrow chunks; the group is never held as a whole
            if latest is None or chunk["ts"].max() > latest:
                latest = chunk["ts"].max()
            ends = chunk[chunk["state"].isin(TERMINAL)]
            if len(ends):
                first = ends.loc[ends["seq"].idxmin()]
                if final is None or int(first["seq"]) < final:
                    known, final = str(first["state"]), int(first["seq"])
        known = known or "analyzing"
        state.update((known, final))
        if timeout_ms is not None and final is None and latest is not None:
            due = int(pd.Timestamp(latest).timestamp() * 1000) + timeout_ms
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif timeout_ms is not None and final is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + marker_ms)
        if (known, final) != before:
            yield _row(scan_id, known, final)

    return step


def _row(scan_id: int, state: str, final: int | None) -> pd.DataFrame:
    return pd.DataFrame({"scan_id": [scan_id], "state": [state], "final_seq": pd.array([final], dtype="Int64")})


def transitions(events: DataFrame, watermark: str = "1 hour", timeout_ms: int | None = None, marker_ms: int = 7 * 86_400_000) -> DataFrame:
    """Stream of state changes per scan from (scan_id, seq, ts, state).

    The end with the lowest sequence number wins even when events come out of order. With
    ``timeout_ms`` a scan that stays open that long in event time fails, and stays failed; what is known of an
    ended scan is forgotten ``marker_ms`` later.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    kind = GroupStateTimeout.EventTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    return (
        timed.select("scan_id", "seq", "ts", "state")
        .groupBy("scan_id")
        .applyInPandasWithState(_fold(timeout_ms, marker_ms), OUTPUT, STATE, "append", kind)
    )


def ends(events: DataFrame) -> DataFrame:
    """Stream of what is known per scan (scan_id, state, final_seq), for output mode ``update``; no time-out.

    The same rule as ``transitions``: the end with the lowest sequence number. As minima, the state of a scan is a few
    numbers that Spark keeps and merges itself, without a call of Python per scan.
    """
    firsts = {s: F.min(F.when(F.col("state") == s, F.col("seq"))).alias(f"_{s}") for s in TERMINAL}
    seen = events.groupBy("scan_id").agg(*firsts.values())
    final = F.least(*[F.col(f"_{s}") for s in TERMINAL])
    named = F.coalesce(*[F.when(F.col(f"_{s}") == F.col("final_seq"), F.lit(s)) for s in TERMINAL], F.lit("analyzing"))
    return seen.withColumn("final_seq", final.cast("bigint")).select("scan_id", named.alias("state"), "final_seq")


def current(changes: DataFrame) -> DataFrame:
    """Polling view over the written changes: analyzing until an end is known."""
    end = F.col("state").isin(*TERMINAL)
    rank = F.coalesce("final_seq", F.lit(2**62))
    return changes.groupBy("scan_id").agg(
        F.coalesce(F.min_by(F.when(end, F.col("state")), F.when(end, rank)), F.lit("analyzing")).alias("state"),
        F.min("final_seq").alias("final_seq"),
    )
