"""A training-data pipeline over ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the
columns of ``documents``. The checks of the stages are brute-force tests: SQL cannot express the classifier, the
MinHash searches or the tokeniser, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.llm import decontaminate, line_dedup, ngram_join, packing, quality
from docrisk.llm.common import source, stored
from docrisk.session import tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.keep_good(docs.select(*COLUMNS), source(tune(spark), sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring template lines; a document of nothing else goes."""
    tune(spark)
    out = line_dedup.drop_lines(docs.select(*COLUMNS))
    kept = out.where((F.col("n_dropped") == 0) | (F.trim(F.col("text")) != ""))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    tune(spark)
    return ngram_join.one_per_class(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), source(tune(spark), sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers

    return packing.pack(tune(spark), docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
