"""Files and requests as they arrive: the batch functions on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docrisk.operators import lifecycle
from docrisk.plans.scan import text_scan


def read_folder(spark: SparkSession, path: str, schema: StructType, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Arriving files as a stream; a batch takes files up to ``bytes_per_trigger``, the rest waits for the next."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(path)


def score(stream: DataFrame, av: DataFrame) -> DataFrame:
    """Scored arrivals. Same function as in batch; the verdict table is joined as a static side."""
    return text_scan(stream, av)


def first_requests(stream: DataFrame, horizon: str = "7 days", time_col: str = "ts") -> DataFrame:
    """Drop repeats of (user_id, request_id) inside the horizon; rows without id never conflict and all pass.

    The event time must be a zoned TIMESTAMP, so a TIMESTAMP_NTZ column is cast first.
    """
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, horizon)
    first = timed.where(F.col("request_id").isNotNull()).dropDuplicatesWithinWatermark(["user_id", "request_id"])
    return first.unionByName(timed.where(F.col("request_id").isNull()))


def store_new_requests(store_path: str):
    """``foreachBatch`` body with an unlimited horizon: keep the first row per request the store lacks.

    Rows without request id all pass. Each batch owns a folder of the store and overwrites it, so a batch that is
    run again after a failure writes the same rows again and adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = lifecycle.first_per_request(batch)
        if batch_id > 0:
            first = lifecycle.new_requests(first, spark.read.parquet(store_path).where(F.col("batch") < batch_id))
        first.select(*batch.columns).write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    return handle


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; progress lives in ``checkpoint``."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a stream of updates, each batch a folder of its own.

    A batch that is run again after a failure overwrites its folder, so it adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
