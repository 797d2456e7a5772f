"""Scan history as queries over the stored scan table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.skew import top_n
from docrisk.operators.scoring import MAX_SCORE, level


def with_level(scans: DataFrame) -> DataFrame:
    return scans.withColumn("risk_level", level(F.col("risk_score")))


def for_user(scans: DataFrame, user_id: int) -> DataFrame:
    """Scans of one user, newest first; the user filter reaches the scan."""
    return scans.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("scan_id"))


def recent(scans: DataFrame, n: int = 5) -> DataFrame:
    """Latest n per user; a user with a huge history is ranked in two steps."""
    return top_n(scans, ["user_id"], [F.desc("created_at"), F.desc("scan_id")], n, rank="recency")


def matches(text: str = "", risk_level: str = "all") -> Column:
    """Name contains the trimmed text, ignoring case, and the level is equal; blank and 'all' do not filter."""
    query = text.strip().lower()
    by_name = F.contains(F.lower("filename"), F.lit(query)) if query else F.lit(True)
    by_level = F.col("risk_level") == risk_level if risk_level != "all" else F.lit(True)
    return by_name & by_level


def search(scans: DataFrame, text: str = "", risk_level: str = "all") -> DataFrame:
    return scans.where(matches(text, risk_level))


def counts(scans: DataFrame, text: str = "", risk_level: str = "all") -> DataFrame:
    """How many of all records a filter shows."""
    return scans.agg(F.count_if(matches(text, risk_level)).alias("shown"), F.count(F.lit(1)).alias("total"))


def get(scans: DataFrame, user_id: int, scan_id: int | None = None) -> DataFrame:
    """One scan of one owner, or all of them; only a completed scan shows risk, only a failed one an error."""
    done = F.col("status") == "completed"
    failed = F.col("status") == "failed"
    owned = F.col("user_id") == user_id
    return scans.where(owned if scan_id is None else owned & (F.col("scan_id") == scan_id)).select(
        "scan_id", "status",
        F.when(done, F.col("filename")).alias("filename"),
        F.when(done, F.col("risk_score")).alias("risk_score"),
        F.when(failed, F.coalesce("error_message", F.lit("File analysis failed."))).alias("error"),
    )


def records(scans: DataFrame) -> DataFrame:
    """List view; facts and evidence are pruned away."""
    return scans.select(
        F.col("scan_id").alias("id"), F.col("filename").alias("name"), F.col("created_at").alias("scanned_at"), F.col("risk_level").alias("risk")
    )


# Fixed value: the three display formats, the first is the default.
DATE_FORMATS = {"DD/MM/YYYY": "dd/MM/yyyy", "MM/DD/YYYY": "MM/dd/yyyy", "YYYY-MM-DD": "yyyy-MM-dd"}


def format_date(value: Column, fmt: str = "DD/MM/YYYY") -> Column:
    """ISO text or timestamp for display; unreadable text gives ``Unknown``."""
    stamp = F.try_to_timestamp(value.cast("string"))
    return F.coalesce(F.date_format(stamp, DATE_FORMATS.get(fmt, DATE_FORMATS["DD/MM/YYYY"])), F.lit("Unknown"))


def to_result(stored: DataFrame) -> DataFrame:
    """Stored row to result row: absent values get their defaults."""
    have = set(stored.columns)
    col = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    return stored.select(
        "scan_id", "filename", col("size", "bigint").alias("size"), col("status").alias("status"),
        col("detected_type").alias("detected_type"), col("detected_mime").alias("detected_mime"),
        F.coalesce(col("extension_mismatch", "boolean"), F.lit(False)).alias("extension_mismatch"),
        F.lit("sha256").alias("hash_algorithm"), col("sha256").alias("hash_value"),
        F.coalesce(col("av_engine"), F.lit("clamav")).alias("av_engine"),
        F.coalesce(col("av_available", "boolean"), F.lit(False)).alias("av_available"),
        F.coalesce(col("av_status"), F.lit("error")).alias("av_status"),
        F.coalesce(col("av_details"), F.lit("")).alias("av_details"),
        col("risk_score", "int").alias("risk_score"), col("risk_level").alias("risk_level"), col("verdict").alias("verdict"),
    )


def display(results: DataFrame) -> DataFrame:
    """Values a viewer shows when a result lacks them; the score stays within 0 and 100."""
    score = F.coalesce("risk_score", F.lit(0))
    return results.withColumn("shown_score", F.greatest(F.lit(0), F.least(F.lit(MAX_SCORE), score))).withColumn(
        "shown_level", F.coalesce("risk_level", F.lit("unknown"))
    ).withColumn("shown_verdict", F.coalesce("verdict", F.lit("review"))).withColumn(
        "evidence_count", F.greatest(F.size(F.coalesce("evidence", F.array().cast(results.schema["evidence"].dataType))), F.lit(0))
    )
