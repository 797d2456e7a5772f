"""The whole scan on a stream: arrivals and announced facts meet in keyed state, under watermarks and with a time-out.

Facts themselves stay in tables. What streams are small rows: that a file has arrived and which formats' facts it
needs, and that the facts of a file in one format are complete. A file is ready when all it needs is there, or when its
time is up; then the batch scan decides it, from the facts that were announced in time. A format that was not has no
facts, so the file gets the evidence of missing facts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docrisk.operators import identity
from docrisk.plans import scan as plan

OUTPUT = "file_id bigint, known string, timed_out boolean"
STATE = "files string"


def wanted(files: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """``files`` with the formats whose facts each needs, comma-joined: by name, leading bytes, and ZIP containers."""
    known = identity.route(identity.detect_type(files))
    asks = {f: F.col(f"route_{f}") for f in formats}
    if "docx" in asks:
        asks["docx"] = asks["docx"] | (F.col("detected_type") == "zip")
    names = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in asks.items()]))
    return files.join(known.select("file_id", F.array_join(names, ",").alias("wanted")), "file_id")


def _names(text: str | None) -> set[str]:
    return set(filter(None, (text or "").split(",")))


def _meet(timeout_ms: int, marker_ms: int):
    """One call keeps the files of a bucket: a call, its frames and its state cost far more than a file does.

    The state is JSON: per file what it needs, what is known, when its time is up, whether it is decided, and until when
    the entry waits for more.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        files = json.loads(state.get[0]) if state.exists else {}
        latest: dict[str, int] = {}
        for chunk in chunks if not state.hasTimedOut else ():
            for file_id, at, need, name in zip(*(chunk[c].tolist() for c in ("file_id", "at", "wanted", "format"))):
                if not file_id:  # a heartbeat moves the watermark and nothing else
                    continue
                entry = files.setdefault(file_id, [None, "", None, False, None])
                latest[file_id] = max(at, latest.get(file_id, at))
                if entry[3]:  # facts that come later change nothing
                    continue
                if name is not None and name not in entry[1].split(","):
                    entry[1] = ",".join(sorted(_names(entry[1]) | {name}))
                if need is not None and (entry[2] is None or at + timeout_ms < entry[2]):  # a repeated arrival counts from the first
                    entry[0], entry[2] = need, at + timeout_ms
        out = []
        for file_id, entry in list(files.items()):
            need, known, due, decided, until = entry
            if file_id in latest:
                if decided:
                    continue
                if need is not None and _names(need) <= _names(known):
                    out.append((int(file_id), known, False))
                    files[file_id] = [None, "", None, True, now + marker_ms]
                else:
                    entry[4] = max(due if due is not None else latest[file_id] + marker_ms, now + 1)
            elif until < now:
                if decided or need is None:  # a marker that has served its time, or facts of a file that never came
                    del files[file_id]
                else:
                    out.append((int(file_id), known, True))
                    files[file_id] = [None, "", None, True, now + marker_ms]
        if files:
            state.update((json.dumps(files),))
            state.setTimeoutTimestamp(max(min(e[4] for e in files.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["file_id", "known", "timed_out"])

    return step


def ready(arrived: DataFrame, announced: DataFrame, delay: str, timeout_ms: int, marker_ms: int = 7 * 86_400_000, buckets: int = 4096) -> DataFrame:
    """Stream of (file_id, known, timed_out), one row per file, when its facts are complete or its time is up.

    ``arrived``: file_id, ts, wanted. ``announced``: file_id, ts, format. Each has its own watermark and the slower
    one counts. Rows without file_id are heartbeats. What is known of a decided file is forgotten ``marker_ms`` later.
    Files are kept by ``buckets`` of their ids; the number belongs to a checkpoint, and a bucket's files lie in one state row.
    """
    a = arrived.select("file_id", F.col("ts").cast("timestamp").alias("ts"), "wanted", F.lit(None).cast("string").alias("format"))
    b = announced.select("file_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("wanted"), "format")
    both = a.withWatermark("ts", delay).union(b.withWatermark("ts", delay))
    # Ids as text: a column with nulls would reach Python as floating point numbers.
    keyed = both.select(
        F.pmod(F.xxhash64("file_id"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("file_id").cast("string"), F.lit("")).alias("file_id"),
        "ts", F.unix_millis("ts").alias("at"), "wanted", "format",
    )
    return keyed.groupBy("bucket").applyInPandasWithState(_meet(timeout_ms, marker_ms), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def decide(files: DataFrame, av: DataFrame, tables: Callable[[dict[str, DataFrame]], plan.Tables], formats: tuple[str, ...], path: str, shown: tuple[str, ...]):
    """``foreachBatch`` body: the ready files of a batch, scanned with the facts known in time.

    ``tables`` gives the fact tables of the files (file_id) per format. Each batch owns its folders and overwrites them,
    so a batch that is run again after a failure adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/ready/batch={batch_id}")  # the state is asked once
        due = spark.read.schema(OUTPUT).parquet(f"{path}/ready/batch={batch_id}")
        if due.isEmpty():
            return
        ids = {f: due.where(F.array_contains(F.split("known", ","), f)).select("file_id") for f in formats}
        found = plan.scan_tables(files.join(due.select("file_id"), "file_id", "left_semi"), av, tables(ids))
        found.select(*shown).write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")

    return handle
