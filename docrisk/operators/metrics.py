"""Quality of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures() -> list[Column]:
    hit, truth = F.col("predicted"), F.col("actual")
    tp, fp = F.count_if(hit & truth), F.count_if(hit & ~truth)
    fn, tn = F.count_if(~hit & truth), F.count_if(~hit & ~truth)
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(tp * 2, tp * 2 + fp + fn).alias("f1"),
        share(fp, fp + tn).alias("false_positive_rate"),
        share(tp, tp + fn).alias("detection_rate"),
    ]


def pair(predictions: DataFrame, labels: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that carry both a prediction and a label."""
    return predictions.join(labels, key)


def binary(paired: DataFrame) -> DataFrame:
    return paired.agg(*_measures())


def by_group(paired: DataFrame, group: str) -> DataFrame:
    """The same per group and in total; the total has a null group."""
    return paired.rollup(group).agg(*_measures())


def confidence(checked: DataFrame, key: str = "item_id") -> DataFrame:
    """Inputs of a reliability check per item: verified share and agreement of rules and stage.

    Counts and ratios only; no probability is claimed. ``checked``: key, verified, rule_hit, stage_hit.
    """
    n = F.count(F.lit(1))
    return checked.groupBy(key).agg(
        n.alias("findings"),
        F.count_if("verified").alias("verified_findings"),
        F.count_if(F.col("rule_hit") == F.col("stage_hit")).alias("agreements"),
        F.round(F.try_divide(F.count_if("verified"), n), 6).alias("verified_share"),
        F.round(F.try_divide(F.count_if(F.col("rule_hit") == F.col("stage_hit")), n), 6).alias("agreement_share"),
    )
