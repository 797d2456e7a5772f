"""Verdict tables keyed by hash: antivirus and reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.signals import strip

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def clean_details(output: Column) -> Column:
    """Text after the last ``: ``, so no local path is kept."""
    text = strip(F.coalesce(output, F.lit("")))
    tail = F.regexp_extract(text, r"(?s)^.*: (.+)$", 1)
    return strip(F.when(tail != "", tail).otherwise(text))


def attach(scans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join on sha256; a hash without verdict is ``unavailable``.

    The verdict side has one row per hash. The scan side stays left, so an adaptive plan may split a
    hash shared by a large group of copies; Spark broadcasts the verdicts only when they are small.
    """
    cols = verdicts.columns
    details = clean_details(F.col("details")) if "details" in cols else F.lit("")
    side = verdicts.select("sha256", F.col("status").alias("_status"), details.alias("_details"))
    default = (
        F.when(F.col("av_status") == "clean", F.lit("no threat found"))
        .when(F.col("av_status") == "threat", F.lit("threat found"))
        .when(F.col("av_status") == "error", F.lit("scan failed"))
        .otherwise(F.lit("no verdict for this hash"))
    )
    return (
        scans.join(side, "sha256", "left")
        .withColumn("av_status", F.coalesce("_status", F.lit("unavailable")))
        .withColumn("av_available", F.col("av_status").isin("clean", "threat"))
        .withColumn("av_details", F.when(F.coalesce("_details", F.lit("")) != "", F.col("_details")).otherwise(default))
        .drop("_status", "_details")
    )


def rank(level: Column) -> Column:
    pairs = [F.lit(x) for kv in RANK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(0))


def reputation(scans: DataFrame, reports: DataFrame) -> DataFrame:
    """Fuse hash reputation: the worst report per hash lifts the level; an unknown hash stays unknown.

    ``reports``: sha256, report ('malware', 'suspicious' or 'clean'). Malware gives high, confirmed by
    two or more reports critical.
    """
    worst = reports.groupBy("sha256").agg(
        F.count_if(F.col("report") == "malware").alias("_malware"), F.count_if(F.col("report") == "suspicious").alias("_suspicious")
    )
    said = (
        F.when(F.col("_malware") >= 2, F.lit("critical"))
        .when(F.col("_malware") == 1, F.lit("high"))
        .when(F.col("_suspicious") > 0, F.lit("medium"))
        .when(F.col("_malware").isNotNull(), F.lit("low"))
    )
    return (
        scans.join(worst, "sha256", "left")
        .withColumn("reputation", F.coalesce(said, F.lit("unknown")))
        .withColumn(
            "fused_level", F.when(rank(said) > rank(F.col("risk_level")), said).otherwise(F.col("risk_level"))
        )
        .drop("_malware", "_suspicious")
    )
