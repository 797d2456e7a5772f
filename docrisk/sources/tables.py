"""Given tables, and the risk-shaped views Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows cost much CPU (whole texts), with the key that spreads them.
HEAVY = {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def spread(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    A file with one row group is read by one task, which would then run every pattern alone. Inputs
    with enough splits, which is every large table, pass unchanged and without a shuffle. A split
    is at most 128 MB, so the exchange never moves more than one split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and pages as one text table (src, item_id, part, text)."""
    docs = table(spark, sf_dir, "documents").selectExpr("'documents' as src", "doc_id as item_id", "'body' as part", "text")
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "'conversations' as src", "conv_id * 1000 + turn as item_id", "role as part", "text"
    )
    pages = table(spark, sf_dir, "pages").selectExpr("'pages' as src", "page_id as item_id", "'html' as part", "html as text")
    return docs.unionByName(turns).unionByName(pages)
