"""Writing results."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.functions.patterns import OUTPUT_LIMIT

FOLDER_FILES = 1000


def write_scans(df: DataFrame, path: str, time_col: str = "created_at", mode: str = "append") -> None:
    """Append scan rows as Parquet by day.

    ``rebalance`` lets the adaptive plan size the output: small days share a task, a day with a third
    of all rows is split over many tasks and files.
    """
    dated = df.withColumn("scan_date", F.to_date(F.col(time_col)))
    dated.hint("rebalance", F.col("scan_date")).write.mode(mode).partitionBy("scan_date").parquet(path)


def write_files(df: DataFrame, path: str, name: str = "filename", content: str = "content", per_folder: int = FOLDER_FILES) -> int:
    """Every row as a file of its own, in folders of about ``per_folder`` files; returns the number of rows.

    ``name`` must be unique. A file's folder follows from its name and it appears whole, under its name, so a task that
    runs twice adds nothing; what a lost task leaves has a hidden name. Spark's writers would make a folder, a move and
    several permission calls per file, and move them all once more in the driver. ``path`` is one that Arrow opens
    (a shared folder, hdfs, s3).
    """
    folders = max(1, df.count() // per_folder)
    placed = df.select(F.pmod(F.xxhash64(name), F.lit(folders)).alias("folder"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for folder, file, data in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{root}/{folder:06d}"
                if folder not in made:
                    store.create_dir(at, recursive=True)
                    made.add(folder)
                hidden = f"{at}/.{uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(data)
                store.move(hidden, f"{at}/{file}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["rows"])

    return placed.mapInArrow(land, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def cap_output(df: DataFrame, max_bytes: int = OUTPUT_LIMIT, keep: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Rows as JSON text with a flag and an error above the limit; the body is always kept."""
    body = F.to_json(F.struct(*df.columns))
    size = F.octet_length(body)
    return df.select(
        *keep,
        size.cast("bigint").alias("output_bytes"),
        (size <= max_bytes).alias("supported"),
        body.alias("body"),
        F.when(size > max_bytes, F.lit("output exceeds the limit")).alias("error"),
    )
