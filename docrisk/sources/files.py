"""Files as bytes: landing, size gates, text decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import compute, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.functions import patterns as P

BATCH_BYTES = 16 * 1024 * 1024
SPARKS_OWN = re.compile(r"[*?\[{\\#%]")
LIMITS = {"json": P.JSON_LIMIT, "docx": P.DOCX_LIMIT, "exe": P.EXE_LIMIT}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def spark_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", file_name(F.col("path")).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("arrived_at"), "content"
    )


def opened(path: str) -> str | None:
    """What a file's path starts with before the path that Arrow takes; none where Arrow finds nothing or reads it unlike Spark (globs)."""
    if SPARKS_OWN.search(path):
        return None
    try:
        store, root = fs.FileSystem.from_uri(path)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return None
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return None
    parts = urlsplit(path)
    return "file:" if store.type_name == "local" else f"{parts.scheme}://{parts.netloc if root.startswith('/') else ''}"


def hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: path, name, size and arrival, also of empty files, which Spark's reader leaves out.

    Tasks list the folders: one lists ``path`` itself, its entries are dealt out, and a task holds one folder's entries at
    a time. Spark's reader would hold every file in the driver; it is left for globs and paths that Arrow does not open.
    """
    start = opened(path)
    if start is None:
        return spark_files(spark, path).drop("content")
    names = ["at", "folder", "size", "arrived_at"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]

    def rows(infos: list[fs.FileInfo]) -> pa.RecordBatch:
        found = [i for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory) and not hidden(i.base_name)]
        cells = [(i.path, i.type == fs.FileType.Directory, i.size, i.mtime_ns and i.mtime_ns // 1000) for i in found]
        return pa.record_batch([pa.array([c[k] for c in cells], t) for k, t in enumerate(types)], names)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for _ in batches:
            info = store.get_file_info(root)
            yield rows(store.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info])

    def files_of(entries: pa.RecordBatch, todo: list[str]) -> pa.RecordBatch:
        folders = entries.column("folder")
        todo += entries.filter(folders).column("at").to_pylist()
        return entries.filter(compute.invert(folders))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            todo = []
            yield files_of(batch, todo)
            while todo:
                yield files_of(rows(store.get_file_info(fs.FileSelector(todo.pop()))), todo)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = "at string, folder boolean, size long, arrived_at timestamp"
    listed = spark.range(0, 1, 1, 1).mapInArrow(top, schema).repartition(tasks).mapInArrow(walk, schema)
    return listed.repartition(tasks).select(  # files are dealt out anew, folders differ in size
        F.concat(F.lit(start), "at").alias("path"), file_name(F.col("at")).alias("filename"), "size", "arrived_at"
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, size, arrival and whole content; ``gate_size`` flags those above a limit.

    Contents are read only where they are used, and leave Python some 16 MB at a time.
    """
    start = opened(path)
    if start is None:
        return spark_files(spark, path)

    @F.pandas_udf("binary")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            data, held = [], 0
            for at in batch:
                with store.open_input_stream(at[len(start):]) as file:
                    data.append(file.read())
                held += len(data[-1])
                if held >= BATCH_BYTES:
                    yield pd.Series(data, dtype=object)
                    data, held = [], 0
            yield pd.Series(data, dtype=object)

    return list_files(spark, path).withColumn("content", content("path"))


def gate_size(df: DataFrame, limits: dict[str, int] = LIMITS, kind: str = "kind", size: str = "size") -> DataFrame:
    """Add ``oversize`` and ``gate_error``; kinds without an own limit use the upload limit."""
    limit = F.lit(P.UPLOAD_LIMIT)
    for name, value in limits.items():
        limit = F.when(F.col(kind) == name, F.lit(value)).otherwise(limit)
    over = F.coalesce(F.col(size) > limit, F.lit(False))
    return df.withColumn("oversize", over).withColumn(
        "gate_error", F.when(over, F.concat(F.lit("size limit exceeded: "), limit.cast("string")))
    )


def decode_utf8(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Add ``valid_utf8`` and the decoded text without byte order mark; invalid bytes give null."""
    ok = F.coalesce(F.is_valid_utf8(F.col(content)), F.lit(False))
    text = F.regexp_replace(F.decode(F.col(content), "UTF-8"), "^\\uFEFF", "")
    return df.withColumn("valid_utf8", ok).withColumn(out, F.when(ok, text))
