"""Report lines: level, what, where, quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(evidence: DataFrame) -> DataFrame:
    """Add ``line``. Columns used: severity, title, location and quote, both optional values."""
    where = F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" found on "), F.col("location"))).otherwise(F.lit(""))
    quote = F.when(
        F.coalesce("quote", F.lit("")) != "", F.concat(F.lit(' containing "'), F.col("quote"), F.lit('"'))
    ).otherwise(F.lit(""))
    return evidence.withColumn("line", F.concat(F.upper("severity"), F.lit(": "), F.lower("title"), where, quote, F.lit(".")))
