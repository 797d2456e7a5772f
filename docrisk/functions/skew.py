"""Top-n per key and small array helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    n: int,
    rank: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows of every key, exactly, in two steps.

    Step one ranks inside ``(key, salt)``: Spark turns the ``<= n`` filter into a limit below the
    shuffle, so a map task ships at most ``n`` rows per key and salt, and a hot key is spread over
    ``salts`` tasks. Step two ranks at most ``n * salts`` survivors per key.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*cols)
    last = Window.partitionBy(*keys).orderBy(*cols)
    name = rank or "_rank"
    out = (
        salted.withColumn("_rank0", F.row_number().over(first))
        .where(F.col("_rank0") <= n)
        .drop("_rank0", "_salt")
        .withColumn(name, F.row_number().over(last))
        .where(F.col(name) <= n)
    )
    return out if rank else out.drop(name)


def _hashable(df: DataFrame) -> list[str]:
    simple = [f.name for f in df.schema.fields if f.dataType.typeName() in _SCALARS]
    return simple or df.columns


_SCALARS = {"byte", "short", "integer", "long", "string", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date"}


def per_value(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Add columns that depend on one column alone, computed once per distinct value of it.

    For work per row that costs far more than moving the row. The rows are the left side: few values become a
    broadcast by their measured size, and of many values an adaptive plan can split a frequent one.
    """
    found = df.select(F.col(key).alias("_value")).distinct().select("_value", *[c.alias(n) for n, c in columns.items()])
    return df.join(found, F.col(key).eqNullSafe(F.col("_value")), "left").drop("_value")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, in n * sqrt(n) steps instead of n * n."""

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def with_blocks(block: Column) -> Column:
        starts_of = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0))),
            lambda b: total(F.slice(lengths, b * block + 1, block)),
        )
        return let(
            starts_of,
            lambda sums: let(
                F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))),
                lambda starts: F.transform(
                    lengths,
                    lambda _, i: F.get(starts, F.floor(i / block).cast("int"))
                    + total(
                        F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i - F.floor(i / block).cast("int") * block)
                    ),
                ),
            ),
        )

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int")), with_blocks)
