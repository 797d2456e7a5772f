"""WARC archives: writing one record per page, and a splittable reader.

The writer gives every record a gzip member of its own, so an archive can be entered at any member. The
reader cuts archives into byte ranges. A task looks for the gzip magic in its range, accepts a candidate
only if the member inflates and begins with a WARC version line, and owns the records whose first byte lies
in its range; the last one may run on past it. No index and no whole file in one task.

Equal payloads: the record with the largest page_id carries the payload, the others revisit it. Null html is
an empty payload. Rows without page_id count as smallest; if several rows share the largest page_id of a
payload, each is a response. Extra columns are ignored, an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.llm.common import partitions, stored
from docrisk.session import work_folder

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16
RECORD_SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary"
)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def header_value(text: str) -> str:
    """Percent-encode what would end or break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id, url, payload: bytes, sha: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the HTTP head and the payload's length, not its bytes."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines.append(f"Content-Length: {len(block)}")
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``payload``, ``sha`` and ``refers_to``; groups of equal payloads of at least ``min_bytes`` have one response.

    The largest id of a payload is a map-side combined maximum over small rows. The pages are the side of the
    join that an adaptive plan splits when one payload is hot.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("hex", F.sha1("payload"))
    first = base.where(F.length("payload") >= min_bytes).groupBy("hex").agg(F.max("page_id").alias("keeper"))
    joined = base.join(first, "hex", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives into ``folder``; returns the manifest (file, n_bytes, n_records).

    A task names its file after its attempt; the manifest is committed by Spark and lists the files of
    successful attempts only, so a repeated task leaves at most an unlisted file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        fs, base = open_folder(folder)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, payload, ref in zip(batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["refers_to"].astype("Int64")):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = bytes(payload)
                data = record_bytes(None if page_id is pd.NA else int(page_id), url, payload, digest(payload), None if ref is pd.NA else int(ref))
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "n_bytes": [size], "n_records": [count]})

    return stored(mark_revisits(pages, min_bytes).mapInPandas(run, "file string, n_bytes long, n_records long"), "warc-manifest")


def parse(data: bytes) -> dict:
    """Fields of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.decode().lower()] = value.strip().decode()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    kind = fields["warc-type"]
    return {
        "record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest(payload) if kind == "response" else fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": len(payload) if kind == "response" else length,
        "refers_to": fields.get("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def starts_record(data: bytes) -> bool:
    """True if a gzip member begins here whose first bytes are a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def read_range(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that begin in [start, stop)."""
    f.seek(start)
    buffer, at = f.read(CHUNK), start  # buffer[0] is the byte at offset ``at``
    found = False
    while at < stop:
        if not found:
            k = buffer.find(MAGIC)
            if k < 0 or k + 512 > len(buffer):  # keep a tail long enough for magic and header
                more = f.read(CHUNK)
                if more:
                    drop = k if k >= 0 else max(0, len(buffer) - 2)
                    buffer, at = buffer[drop:] + more, at + drop
                    continue
                if k < 0:
                    return
            if at + k >= stop:
                return
            if not starts_record(buffer[k : k + 4096]):
                buffer, at = buffer[k + 1 :], at + k + 1
                continue
            buffer, at, found = buffer[k:], at + k, True
        member, parts = zlib.decompressobj(31), []
        offset = at
        data = buffer
        while True:
            parts.append(member.decompress(data))
            if member.eof:
                break
            at += len(data)
            data = f.read(CHUNK)
            if not data:
                raise ValueError(f"record at {offset} is cut off")
        at += len(data) - len(member.unused_data)
        buffer = member.unused_data
        yield offset, b"".join(parts)
        if len(buffer) < len(MAGIC):
            buffer += f.read(CHUNK)
            if not buffer:
                return
        found = False  # what follows is validated like any candidate


def ranges(manifest: DataFrame, split_bytes: int) -> DataFrame:
    return manifest.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))


def read(manifest: DataFrame, folder: str, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of all archives; every byte range of ``split_bytes`` is a row that any task can take."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_folder(folder)
        for batch in batches:
            for name, start, size in zip(batch["file"], batch["start"], batch["n_bytes"]):
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as f:
                    for offset, data in read_range(f, int(start), min(int(start) + split_bytes, int(size))):
                        row = {"file": name, "offset": offset, **parse(data)}
                        if not with_payload:
                            row["payload"] = None
                        held += len(row["payload"] or b"")
                        rows.append(row)
                        if held > (16 << 20) or len(rows) >= 5000:
                            yield pd.DataFrame(rows)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    cut = ranges(manifest, split_bytes)
    return cut.repartition(partitions(cut.sparkSession), "file", "start").mapInPandas(run, RECORD_SCHEMA)


def page_of(uri: str) -> F.Column:
    return F.regexp_extract(F.col(uri), r"urn:page:(-?\d+)", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = work_folder(spark, "warc")
    records = read(write(pages, folder, min_bytes), folder, with_payload=False)
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "target_uri",
    )
