"""Requests and scan state. All folds are min_by or max aggregates, which combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.patterns import REQUEST_ID
from docrisk.functions.signals import strip

TERMINAL = ("completed", "failed")


def valid_id(value: Column) -> Column:
    return F.coalesce(F.rlike(strip(value), F.lit("(?i)" + REQUEST_ID)), F.lit(False))


def valid_request(df: DataFrame, col: str = "request_id") -> DataFrame:
    """Add ``clean_request_id``: trimmed when well formed, else null."""
    return df.withColumn("clean_request_id", F.when(valid_id(F.col(col)), strip(F.col(col))))


def first_per_request(requests: DataFrame, order: str = "seq") -> DataFrame:
    """First row of every (user_id, request_id); rows without a request id never conflict.

    Rows without id take no part in the grouping, so they form no hot null key.
    """
    cols = requests.columns
    keyed = requests.where(F.col("request_id").isNotNull())
    first = keyed.groupBy("user_id", "request_id").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
    return first.unionByName(requests.where(F.col("request_id").isNull()))


def new_requests(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the batch the store lacks; rows without request id always pass.

    The store is first cut to the keys of the batch. With a small batch that is a broadcast semi join,
    Spark's own size check deciding, so the store is read once and not shuffled.
    """
    keys = ["user_id", "request_id"]
    keyed = batch.where(F.col("request_id").isNotNull())
    known = store.select(*keys).join(keyed.select(*keys).distinct(), keys, "left_semi").distinct()
    fresh = keyed.join(known, keys, "left_anti")
    return fresh.unionByName(batch.where(F.col("request_id").isNull()))


def replies(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Answers for requests the store already has: the stored scan and its state."""
    known = (
        store.where(F.col("request_id").isNotNull())
        .groupBy("user_id", "request_id")
        .agg(F.min_by(F.struct(F.col("scan_id").alias("stored_scan_id"), F.col("state").alias("stored_state")), "scan_id").alias("k"))
        .select("user_id", "request_id", "k.*")
    )
    return batch.where(F.col("request_id").isNotNull()).join(known, ["user_id", "request_id"])


def current_state(events: DataFrame) -> DataFrame:
    """State per scan: the first terminal event is final, otherwise analyzing.

    Two minima over numbers decide it. Unlike a minimum over text they aggregate in hash tables,
    without sorting the events first.
    """
    first = lambda cond: F.min(F.when(cond, F.col("seq")))
    folded = events.groupBy("scan_id").agg(
        first(F.col("state").isin(*TERMINAL)).alias("final_seq"),
        first(F.col("state") == "failed").alias("_failed"),
        F.count(F.lit(1)).alias("events"),
    )
    state = (
        F.when(F.col("final_seq").isNull(), F.lit("analyzing"))
        .when(F.col("_failed") == F.col("final_seq"), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    return folded.select("scan_id", state.alias("state"), "final_seq", "events")


def failed_messages(states: DataFrame) -> DataFrame:
    """Failed scans keep a message; a missing one gets the default."""
    return states.withColumn(
        "error_message", F.when(F.col("state") == "failed", F.coalesce("error_message", F.lit("File analysis failed.")))
    )
