"""Mergeable measures: facts as one keyed fold over many sources.

A measure is a value computed on a source row and an aggregate that merges values, partial ones included. Sources with
different rows become one tagged union: each is projected to the key and its own measures, the others' measures are null there
and change nothing. The union is aggregated once, so that many fact tables cost one exchange on the key, of partial
aggregates and not of rows, and every source is read once. The same measures roll up a single source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    value: Column
    merge: Callable[[Column], Column]


Measures = dict[str, Measure]


def rows() -> Measure:
    return Measure(F.lit(1), F.count)


def count_if(cond: Column) -> Measure:
    return Measure(F.when(cond, F.lit(1)), F.count)


def any_(cond: Column) -> Measure:
    return Measure(cond, F.bool_or)


def total(value: Column) -> Measure:
    return Measure(value.cast("bigint"), F.sum)


def only(value: Column) -> Measure:
    """The value of the one row a key has in its source."""
    return Measure(value, lambda c: F.any_value(c, F.lit(True)))


def names(value: Column) -> Measure:
    """Sorted union of arrays of names from a fixed list; what is kept are combinations, so it has a bound."""
    return Measure(value, lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))))


def first_by(value: Column, order: Column) -> Measure:
    """The value with the smallest order; rows without order do not count."""
    pair = F.when(order.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
    return Measure(pair, lambda c: F.min_by(c["v"], c["o"]))


def last_by(value: Column, order: Column) -> Measure:
    pair = F.when(order.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
    return Measure(pair, lambda c: F.max_by(c["v"], c["o"]))


def rolled(source: DataFrame, key: str, measures: Measures) -> DataFrame:
    """One row per key with a source's measures."""
    return source.groupBy(key).agg(*[m.merge(m.value).alias(n) for n, m in measures.items()])


@dataclass(frozen=True)
class Source:
    """Rows of one fact table, with the prefix that sets its measures apart from those of others."""

    rows: DataFrame
    key: str
    prefix: str
    measures: Measures


def folded(sources: list[Source], key: str) -> DataFrame:
    """One row per key with the measures of all sources, named prefix and measure."""
    parts = [s.rows.select(F.col(s.key).alias(key), *[m.value.alias(s.prefix + n) for n, m in s.measures.items()]) for s in sources]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.groupBy(key).agg(*[m.merge(F.col(s.prefix + n)).alias(s.prefix + n) for s in sources for n, m in s.measures.items()])


def unprefixed(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with the columns of one prefix under their plain names."""
    return df.select(*[F.col(c).alias(c.removeprefix(prefix)) if c.startswith(prefix) else F.col(c) for c in df.columns])
