"""Session defaults. A value the cluster already set always wins."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# SQL settings the operators are designed for.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even when the next operator then needs its own exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Type detection accepts objects with repeated keys.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # File contents travel to Python workers in batches of bounded bytes, not of 10,000 rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}

# Views and rules shuffle narrow rows: 64 MB of them, compressed, are millions of groups in one task. Exchanges start
# from enough partitions to stay at 16 MB a task; small ones are still joined into few.
PARTITIONS = 200
NARROW = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024)}
FEW = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(PARTITIONS)}
OURS = "docrisk.narrow"


def tune(spark: SparkSession, narrow: bool = False) -> SparkSession:
    """Apply DEFAULTS where the session leaves them unset, for ``narrow`` rows NARROW too.

    FEW holds where the session has fewer partitions. What an earlier call set for narrow rows is taken back.
    """
    for key in spark.conf.get(OURS, "").split():
        spark.conf.unset(key)
    chosen = spark.conf.getAll
    few = int(spark.conf.get("spark.sql.shuffle.partitions")) < PARTITIONS
    extra = {k: v for k, v in (NARROW | (FEW if few else {})).items() if narrow and k not in chosen}
    for key, value in (DEFAULTS | extra).items():
        if key not in chosen:
            spark.conf.set(key, value)
    spark.conf.set(OURS, " ".join(extra))
    return spark


def local_session(cores: int | str = 8, app: str = "docrisk") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder the cluster names.

    Only a local master may fall back to a folder of this machine.
    """
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/docrisk/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
