"""Checksums and entropy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.functions import signals
from docrisk.functions.skew import let


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, numbered 0-4 rotations, 5-9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


# Fixed value: the one digit permutation of the Verhoeff scheme; position i uses its i-th power.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _powers() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_STEP[x] for x in rows[-1]])
    return rows


VERHOEFF_PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
VERHOEFF_POWER = [x for row in _powers() for x in row]


def verhoeff(digits: Column) -> Column:
    """True for a digit string whose last digit is its Verhoeff check digit."""
    product = F.array(*[F.lit(x) for x in VERHOEFF_PRODUCT])
    power = F.array(*[F.lit(x) for x in VERHOEFF_POWER])

    def fold(backwards: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(backwards)),
            F.lit(0),
            lambda acc, i: F.get(
                product,
                acc * 10
                + F.get(power, F.pmod(i - 1, F.lit(8)) * 10 + F.substring(backwards, i, F.lit(1)).cast("int")),
            ),
        )

    valid = F.rlike(digits, F.lit("^[0-9]{2,}$"))
    return F.coalesce(F.when(valid, let(F.reverse(digits), fold) == 0), F.lit(False))


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy in bits per byte, three decimals; 0 for empty content.

    A numpy histogram per value: exploding one row per byte would multiply the data by its size.
    """

    def one(blob: bytes | None) -> float:
        if not blob:
            return 0.0
        counts = np.bincount(np.frombuffer(blob, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / len(blob)
        return round(float(-(share * np.log2(share)).sum()) + 0.0, 3)

    return content.map(one).astype("float64")


def char_entropy(text: Column) -> Column:
    """Entropy in bits per character of a short token, inside the JVM."""

    def of(distinct: Column) -> Column:
        return F.aggregate(
            distinct,
            F.lit(0.0),
            lambda acc, c: acc - _plog(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.length(text)),
        )

    return F.coalesce(
        F.when(F.length(text) > 0, let(F.array_distinct(F.split(text, "(?s)(?<=.)(?=.)")), of)), F.lit(0.0)
    )


def _plog(n: Column, total: Column) -> Column:
    share = n / total
    return share * F.log2(share)


def register(spark: SparkSession) -> None:
    """SQL names: verhoeff, redact_url, extract_ips, byte_entropy and the json_nodes table function."""
    from docrisk.operators.jsonnodes import json_nodes_udtf

    spark.udf.register("byte_entropy", byte_entropy)
    spark.udtf.register("json_nodes", json_nodes_udtf())
    product = ",".join(map(str, VERHOEFF_PRODUCT))
    power = ",".join(map(str, VERHOEFF_POWER))
    spark.sql(
        f"""create or replace temporary function verhoeff(d string) returns boolean return
        d rlike '^[0-9]{{2,}}$' and aggregate(sequence(1, length(d)), 0, (a, i) ->
          get(array({product}), a * 10 + get(array({power}),
            (i - 1) % 8 * 10 + cast(substring(reverse(d), i, 1) as int)))) = 0"""
    )
    spark.sql(
        r"""create or replace temporary function redact_url(u string) returns string return
        regexp_replace(regexp_replace(u, '(?i)(https?://)[^/@\\s]+@', '$1[redacted]@'), '[?#].*$',
          if(contains(u, '?'), '?[redacted]', '#[redacted]'))"""
    )
    spark.sql(
        r"""create or replace temporary function extract_ips(t string) returns array<string> return
        array_distinct(filter(regexp_extract_all(t, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', 0),
          a -> forall(split(a, '\\.'), p -> cast(p as int) <= 255)))"""
    )


__all__ = ["verhoeff", "byte_entropy", "char_entropy", "register", "signals"]
