"""Token-id files: flat unsigned integers and 64-bit document offsets, written by partitions and read by memory map.

A corpus is a folder. Each part has three flat little-endian files without headers: ``.tokens`` (ids, 16 bits wide
if the vocabulary allows, else 32), ``.offsets`` (64-bit, one more than there are documents: where each begins in
its part) and ``.docs`` (64-bit document ids). ``index.json`` lists the parts in order with their bases: the
documents and ids of all parts before, which are prefix sums over the parts' own counts. Nothing is rewritten to
learn them, and the offset of a document in the corpus is its part's base plus its own offset.

Documents lie in ascending doc_id; those without one come first; rows that share a doc_id are ordered by a hash of
their text. The order comes from a range exchange on (doc_id, text hash), so neither a repeated doc_id nor many
rows without one fill a single part; only rows equal in both stay together, and a part is written as a stream.
Null and empty texts are documents of the end id alone. Very long texts are encoded whole, one at a time. The
string of a special token in a text becomes that token's id. An empty table gives an index without parts, and no
rows. Extra columns are ignored, whatever their names.

A task names its files after its attempt, and the table of parts is committed by Spark, so a repeated task leaves
at most files that no index lists.
"""

from __future__ import annotations

import contextlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.llm import tokens
from docrisk.llm.common import partitions, stored
from docrisk.llm.warc import open_folder
from docrisk.session import work_folder

END_ID = 2
BLOCK = 1 << 20  # ids held at once while reading
PART_SCHEMA = "part long, file string, width long, n_docs long, n_ids long, n_null long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---- writing -------------------------------------------------------------------------------------------------
def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> list[dict]:
    """Encode ``docs`` (doc_id, text) into ``folder`` and return its parts in order, as ``index.json`` lists them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.ByteEncoder, tokenizer_path)
        kind = encoder.kind if end_id <= np.iinfo(encoder.kind).max else np.dtype("<u4")
        end = np.array([end_id], kind).tobytes()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        n_docs = n_ids = n_null = 0
        with contextlib.ExitStack() as stack:
            out = None
            for batch in batches:
                if out is None:
                    fs, base = open_folder(folder)
                    fs.create_dir(base, recursive=True)
                    out = {x: stack.enter_context(fs.open_output_stream(f"{base}/{name}.{x}", compression=None)) for x in ("tokens", "offsets", "docs")}
                    out["offsets"].write(np.zeros(1, "<i8").tobytes())
                offsets = []
                for found in encoder.ids(batch["text"].tolist()):
                    out["tokens"].write(found.astype(kind, copy=False).tobytes() + end)
                    n_ids += len(found) + 1
                    offsets.append(n_ids)
                ids = batch["doc_id"].astype("Int64")
                out["offsets"].write(np.asarray(offsets, "<i8").tobytes())
                out["docs"].write(ids.fillna(0).to_numpy("<i8").tobytes())
                n_null += int(ids.isna().sum())
                n_docs += len(batch)
        if n_docs:
            yield pd.DataFrame([(context.partitionId(), name, kind.itemsize, n_docs, n_ids, n_null)], columns=["part", "file", "width", "n_docs", "n_ids", "n_null"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "order").sortWithinPartitions("doc_id", "order")
    written = stored(ordered.select("doc_id", "text").mapInPandas(run, PART_SCHEMA), "token-parts")
    parts, first_doc, first_id = [], 0, 0
    for r in written.orderBy("part").collect():  # one row per task, whatever the documents
        parts.append({"file": r["file"], "width": r["width"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "n_null": r["n_null"], "first_doc": first_doc, "first_id": first_id})
        first_doc, first_id = first_doc + r["n_docs"], first_id + r["n_ids"]
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/index.json", compression=None) as f:
        f.write(json.dumps({"end_id": end_id, "n_docs": first_doc, "n_ids": first_id, "parts": parts}).encode())
    return parts


# ---- reading -------------------------------------------------------------------------------------------------
def flat(fs: pafs.FileSystem, path: str, kind: str, first: int, count: int) -> np.ndarray:
    """``count`` integers from place ``first`` on: a memory map where the file system is a mounted one, else a ranged read."""
    dtype = np.dtype(kind)
    if not count:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", first * dtype.itemsize, (count,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * dtype.itemsize, first * dtype.itemsize), dtype)


class Corpus:
    """A folder of token files, opened without Spark: ``corpus[i]`` is document i in file order."""

    def __init__(self, folder: str):
        self.fs, self.base = open_folder(folder)
        with self.fs.open_input_stream(f"{self.base}/index.json") as f:
            self.index = json.loads(f.read())
        self.firsts = np.array([p["first_doc"] for p in self.index["parts"]], np.int64)

    def __len__(self) -> int:
        return self.index["n_docs"]

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        part = self.index["parts"][int(np.searchsorted(self.firsts, i, side="right")) - 1]
        path = f"{self.base}/{part['file']}"
        a, b = (int(v) for v in flat(self.fs, f"{path}.offsets", "<i8", i - part["first_doc"], 2))
        return flat(self.fs, f"{path}.tokens", f"<u{part['width']}", a, b - a)


def crc_of(fs: pafs.FileSystem, path: str, kind: str, a: int, b: int, block: int = BLOCK) -> int:
    """CRC of ids [a, b) as 32-bit integers, by blocks."""
    crc = 0
    for at in range(a, b, block):
        crc = zlib.crc32(flat(fs, path, kind, at, min(block, b - at)).astype("<u4"), crc)
    return crc


def read(spark: SparkSession, folder: str, parts: list[dict], block_docs: int = 5_000, block_ids: int = BLOCK) -> DataFrame:
    """Documents of a corpus: doc_id, start (ids before it), n_tokens and the CRC of its ids as 32-bit integers.

    Tasks take runs of ``block_docs`` documents, so a large part is read by many.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_folder(folder)
        for batch in batches:
            for r in batch.itertuples(index=False):
                path, kind, count = f"{base}/{r.file}", f"<u{r.width}", min(block_docs, r.n_docs - r.at)
                offsets = np.asarray(flat(fs, f"{path}.offsets", "<i8", r.at, count + 1))
                ids = pd.array(np.asarray(flat(fs, f"{path}.docs", "<i8", r.at, count)), "Int64")
                ids[: max(0, min(count, r.n_null - r.at))] = pd.NA  # documents without id come first
                crcs = []
                i = 0
                while i < count:  # documents whose ids fit a block are read together
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_ids, side="right")) - 1)
                    a, b = int(offsets[i]), int(offsets[j])
                    if j == i + 1:
                        crcs.append(crc_of(fs, f"{path}.tokens", kind, a, b, block_ids))
                    else:
                        block = memoryview(flat(fs, f"{path}.tokens", kind, a, b - a).astype("<u4").tobytes())
                        cuts = ((offsets[i : j + 1] - a) * 4).tolist()
                        crcs.extend(zlib.crc32(block[x:y]) for x, y in zip(cuts, cuts[1:]))
                    i = j
                yield pd.DataFrame({"doc_id": ids, "start": r.first_id + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": crcs})

    schema = "file string, width long, n_docs long, n_ids long, n_null long, first_doc long, first_id long"
    rows = spark.createDataFrame([tuple(p[c.split()[0]] for c in schema.split(", ")) for p in parts], schema)
    runs = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(block_docs))))
    return runs.repartition(partitions(spark), "file", "at").mapInPandas(run, READ_SCHEMA)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents and read them back."""
    folder = work_folder(spark, "tokens")
    return read(spark, folder, write(docs, folder, tokenizer_path, end_id))
