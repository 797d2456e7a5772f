"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles. A
text of fewer words is one shingle, a text without words has an empty sketch. Sketches merge: the k smallest
of two sketches are the sketch of both texts together.

Null text counts as empty; very long texts are sketched whole; equal texts have equal sketches; extra columns
are ignored; an empty table gives an empty result. Two empty sketches resemble each other fully (1.0), an
empty and a filled one not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.functions.skew import let
from docrisk.llm.common import partitions

K = 128
SHINGLE = 5
_TOP = 2**63 - 1


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Bottom-k sketch of the n-word shingles of ``text``."""

    def hashes(w: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(0), F.size(w) - n),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]),
        )
        return F.when(F.size(w) >= n, full).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.coalesce(text, F.lit(""))), lambda w: F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: str | Column, k: int = K) -> Column:
    """Aggregate: sketch of all parts of a group.

    The k smallest distinct hashes are found hash by hash, so no task holds more than the distinct hashes it
    has seen of a group; explode and ``merge_groups`` for groups of unbounded size.
    """
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketches)))), 1, k)


def merge_groups(parts: DataFrame, key: str, sketches: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per ``key`` in two steps, so that a hot key is folded by ``salts`` tasks first."""
    salted = parts.select(key, sketches).withColumn("_salt", F.pmod(F.xxhash64(sketches), F.lit(salts)))
    first = salted.select(key, "_salt", F.explode(sketches).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("_h"))
    few = first.withColumn("_r", rank).where(F.col("_r") <= k)
    return few.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketches))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, k).cast("double") / F.lit(float(_TOP)) + 1.0) / 2.0
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: share of the merged sketch that both have."""
    merged = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(merged, a), b)) / F.size(merged)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(both, F.lit(0.0)).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def to_string(s: Column) -> Column:
    """The sketch as text: 16 hex digits per hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds ``nx``, the text of the next row by descending doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id (bounds by approximate quantiles, a bounded list) and ordered inside
    each range. The first row of every range is copied to the end of the range before it, so texts move once
    and no range needs another. Rows without doc_id come last. Equal ids are ordered by the text's hash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts or 4 * partitions(spark)  # several ranges for each task, so that they even out
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    found = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < key)) if bounds else F.lit(0)
    dealt = docs.withColumn("bucket", bucket)
    # One small row per range: its first row by descending doc_id.
    heads = dealt.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket")).collect()
    rows = [(a["doc_id"], b["bucket"]) for a, b in zip(heads[1:] + heads[:1], heads)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("to", T.IntegerType())])
    moves = F.broadcast(spark.createDataFrame(rows, schema))  # one row per range
    ghosts = docs.join(moves.withColumnRenamed("doc_id", "head"), F.col("doc_id").eqNullSafe(F.col("head"))).select(
        F.col("to").alias("bucket"), F.lit(True).alias("ghost"), "doc_id", "text"
    )
    both = dealt.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text").unionByName(ghosts)
    return both.withColumn("nx", F.lead("text").over(in_range()))


def in_range():
    return Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def fingerprint(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited form, and likeness to the edited form and the next text."""
    chained = with_next(docs)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - div(length(text), 3))"), F.expr("substring(nx, 1, div(length(text), 3))"))
    own = chained.withColumn("fp", sketch(F.col("text"), k))
    own = own.withColumn("next_fp", F.lead("fp").over(in_range())).where(~F.col("ghost"))
    out = own.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    out = out.withColumn("efp", sketch(F.col("edited"), k))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), to_string(F.col("fp")).alias("fingerprint"),
        to_string(F.col("efp")).alias("edited_fingerprint"), resemblance(F.col("fp"), F.col("efp"), k).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"), distinct_shingles(F.col("fp"), k).alias("n_shingles"),
        containment(F.col("efp"), F.col("fp"), k).alias("edited_in_own"),
    )
