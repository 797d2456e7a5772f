"""Verifier: a proposed finding counts only when its exact quote stands at its location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(proposed: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``verified``. ``proposed``: item_id, part, quote, start_pos (1-based or null).

    With a position the quote must start there, else it may stand anywhere.
    The texts meet the few proposed quotes in an inner join, which may broadcast the quotes, and leave
    only the fact of a match; whole texts are not carried through a second join.
    """
    keys = ["item_id", "part", "quote", "start_pos"]
    there = F.substring(F.col("text"), F.col("start_pos"), F.length("quote")) == F.col("quote")
    ok = F.when(F.col("start_pos").isNotNull(), there).otherwise(F.contains("text", F.col("quote")))
    matched = (
        texts.select("item_id", "part", "text")
        .join(proposed.select(*keys).distinct(), ["item_id", "part"])
        .where(ok & (F.length("quote") > 0))
        .select(*[F.col(k).alias(f"_{k}") for k in keys])
        .distinct()
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        proposed.join(matched, same, "left")
        .withColumn("verified", F.col("_item_id").isNotNull())
        .drop(*[f"_{k}" for k in keys])
    )


def hallucination_rate(checked: DataFrame, *by: str) -> DataFrame:
    """Unverified findings over all findings, overall or per group."""
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(~F.col("verified")).alias("unverified"),
        F.try_divide(F.count_if(~F.col("verified")), F.count(F.lit(1))).alias("hallucination_rate"),
    )
