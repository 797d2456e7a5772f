"""Override requests, audit rows, rollups and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lifecycle(events: DataFrame) -> DataFrame:
    """Fold override events (event_id, seq, state, actor, owner) and judge every row.

    Legal path: PENDING_APPROVAL, then APPROVED or REJECTED by somebody else than the owner, then
    RELEASED after APPROVED. The first legal row of a step counts; other rows are violations. Each
    step is a min aggregate, so one event with very many rows needs no window over them.
    """
    pending = events.where(F.col("state") == "PENDING_APPROVAL").groupBy("event_id").agg(F.min("seq").alias("pending_seq"))
    with_start = events.join(pending, "event_id", "left")
    decision = F.col("state").isin("APPROVED", "REJECTED") & (F.col("seq") > F.col("pending_seq")) & (F.col("actor") != F.col("owner"))
    decided = (
        with_start.where(decision)
        .groupBy("event_id")
        .agg(F.min("seq").alias("decision_seq"), F.min_by("state", "seq").alias("decision"))
    )
    with_decision = with_start.join(decided, "event_id", "left")
    release = (F.col("state") == "RELEASED") & (F.col("decision") == "APPROVED") & (F.col("seq") > F.col("decision_seq"))
    released = with_decision.where(release).groupBy("event_id").agg(F.min("seq").alias("release_seq"))
    full = with_decision.join(released, "event_id", "left")
    legal = F.coalesce(
        F.col("seq").eqNullSafe(F.col("pending_seq"))
        | F.col("seq").eqNullSafe(F.col("decision_seq"))
        | F.col("seq").eqNullSafe(F.col("release_seq")),
        F.lit(False),
    )
    return full.withColumn("legal", legal).select("event_id", "seq", "state", "actor", "owner", "legal")


def current(judged: DataFrame) -> DataFrame:
    """State per event after its legal rows; null when none is legal."""
    return judged.groupBy("event_id").agg(
        F.max_by(F.when(F.col("legal"), F.col("state")), F.when(F.col("legal"), F.col("seq"))).alias("state"),
        F.count_if(~F.col("legal")).alias("violations"),
    )


def audit(judged: DataFrame) -> DataFrame:
    """Append-only audit rows: who moved what to which state, and whether it was allowed."""
    return judged.select(
        "event_id", "seq", "actor", "state", F.when(F.col("legal"), F.lit("applied")).otherwise(F.lit("refused")).alias("outcome")
    )


def write_audit(judged: DataFrame, path: str) -> None:
    audit(judged).write.mode("append").parquet(path)


def summary(events: DataFrame) -> DataFrame:
    """Counts by pipeline and level with subtotals; a null key marks a subtotal."""
    return events.rollup("pipeline", "risk_level").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("decision") == "BLOCK").alias("blocked")
    )


def entity_counts(events: DataFrame, counts: str = "entity_counts") -> DataFrame:
    """Events and total hits per entity type."""
    return (
        events.select(F.explode(counts).alias("entity_type", "n"))
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("n").cast("bigint").alias("hits"))
    )


def alerts(events: DataFrame) -> DataFrame:
    """Metadata of blocked events for notifications; no text, no values."""
    return events.where(F.col("decision") == "BLOCK").select(
        "event_id", "risk_level", F.array_join(F.array_sort(F.map_keys("entity_counts")), ",").alias("entity_types")
    )
