"""Packing of token sequences into windows, by non-negative least squares over a length histogram.

A document's tokens are cut at every full window; each full window is a sequence. What remains (shorter than a
window) is counted by length. The histogram, never longer than the window, is planned on the driver:

1. lengths are grouped into slots (rounded up), shallow combinations (two or three slots that fill the window)
   are enumerated, and non-negative least squares finds how often each is used so that the slots come out;
2. the counts are rounded down, and what the combinations leave over is packed greedily, longest first with the
   best fit, as long as a sequence gets nearly full;
3. what then still leaves gaps is laid end to end and cut at windows, at multiples of ``GRAIN`` tokens.

Rows learn their place from their length and their rank among rows of that length. Ranks come from counts per
(length, salt), so a length that a third of all rows share is spread over tasks. CRCs of pieces are kept from
the tokenising pass (prefix CRCs at every GRAIN), so texts are read and tokenised once.

Null and empty texts have one token, the end id. Very long texts take one window after another. Repeated rows
are packed each for itself. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrisk.llm import tokens
from docrisk.llm.common import partitions, stored

WINDOW = 4096
SLOT = 16
GRAIN = 32
END_ID = 2
FULL = 0.985  # a greedy sequence below this share is laid end to end instead
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"


# ---- tokens --------------------------------------------------------------------------------------------------
def measure(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Per row: token count, CRC of every full window, and prefix CRCs of the remainder at every GRAIN and its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokens.WordEncoder, tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for ids in encoder.ids(batch["text"].tolist()):
                data = ids.astype("<u4").tobytes() + end
                n, size = len(data) // 4, window * 4
                full = n // window
                crcs = [zlib.crc32(data[i * size : (i + 1) * size]) for i in range(full)]
                rest, c, prefix = memoryview(data)[full * size :], 0, []
                for at in range(0, len(rest), GRAIN * 4):
                    c = zlib.crc32(rest[at : at + GRAIN * 4], c)
                    prefix.append(c)
                rows.append((n, crcs, np.array(prefix, "<u4").tobytes()))
            out = pd.DataFrame(rows, columns=["n_tokens", "full_crcs", "prefix"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(run, "doc_id long, n_tokens long, full_crcs array<long>, prefix binary")


# ---- CRC of a middle part from two prefix CRCs ---------------------------------------------------------------
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC polynomial."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
        bit >>= 1
    return out


def _shift(n_bytes: int) -> int:
    """x to the power 8 n_bytes."""
    out, square, k = 1 << 31, 1 << 30, 8 * n_bytes
    while k:
        if k & 1:
            out = _times(square, out)
        square = _times(square, square)
        k >>= 1
    return out


def crc_of_part(before: int, through: int, n_bytes: int) -> int:
    """CRC of the last ``n_bytes`` of a run, given the CRCs of the run and of what precedes them."""
    return through ^ _times(_shift(n_bytes), before) if before else through


# ---- plan (driver; its size depends on the window only) ------------------------------------------------------
def combinations(slots: int) -> np.ndarray:
    """Rows of slot counts: two or three slots that fill the window, and the full slot alone."""
    rows = []
    for a in range(1, slots + 1):
        if a == slots:
            rows.append((a,))
        for b in range(a, slots + 1):
            if a + b == slots:
                rows.append((a, b))
            c = slots - a - b
            if c >= b:
                rows.append((a, b, c))
    out = np.zeros((len(rows), slots + 1))
    for i, r in enumerate(rows):
        for x in r:
            out[i, x] += 1
    return out[:, 1:]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by the active-set method: min |a x - b| with x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, abs(a.T @ b).max())
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)  # no Gram matrix of all columns: there are far more columns than rows
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * scale:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            best = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (best > 1e-12).all():
                x[:] = 0
                x[idx] = best
                break
            low = best <= 1e-12
            old = x[idx]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(low & (old > best), old / (old - best), np.inf)
            step = min(1.0, ratio.min())
            x[idx] = old + step * (best - old)
            gone = idx[low & (x[idx] <= 1e-12)]
            if not len(gone):
                gone = idx[low]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def greedy(counts: np.ndarray, window: int) -> tuple[list[tuple[list[tuple[int, int]], int]], np.ndarray]:
    """Longest-first best-fit patterns [(length, times)...] with repeat counts; stops adding those that stay below FULL."""
    counts, out, left = counts.copy(), [], np.zeros_like(counts)
    lengths = [int(i) for i in np.flatnonzero(counts)]
    while lengths:
        top = lengths[-1]
        room, pattern, used = window, [], {}
        at = len(lengths) - 1
        while room > 0 and at >= 0:
            ln = lengths[at]
            if ln > room:
                at = int(np.searchsorted(lengths, room, side="right")) - 1
                continue
            times = min(room // ln, int(counts[ln]))
            pattern.append((ln, times))
            used[ln] = times
            room -= times * ln
            at -= 1
        if window - room < FULL * window:
            left[top] += counts[top]
            counts[top] = 0
        else:
            repeat = min(int(counts[ln]) // t for ln, t in used.items())
            out.append((pattern, repeat))
            for ln, t in used.items():
                counts[ln] -= t * repeat
        lengths = [ln for ln in lengths if counts[ln] > 0]
    return out, left


def plan(hist: dict[int, int], window: int = WINDOW) -> tuple[pd.DataFrame, dict[int, tuple[int, int]], int, int]:
    """Places for every (length, rank): intervals, tape starts by length, first tape sequence, next free sequence.

    Intervals: rank in [lo, hi) of ``length`` goes to sequence ``seq + (rank - lo + skip) // per`` at slot
    ``slot + (rank - lo + skip) % per``.
    """
    count = np.zeros(window, np.int64)
    for ln, n in hist.items():
        count[ln] = n
    used = np.zeros(window, np.int64)  # ranks of each length already placed
    rows, seq = [], 0
    slots = window // SLOT
    slot_of = lambda ln: -(-ln // SLOT)
    supply = np.zeros(slots, np.int64)
    for ln in np.flatnonzero(count):
        supply[slot_of(int(ln)) - 1] += count[ln]
    combos = combinations(slots)
    combos = combos[(combos[:, supply == 0] == 0).all(axis=1)]
    if len(combos):
        times = np.floor(nnls(combos.T, supply.astype(float)) + 1e-6).astype(np.int64)
        for combo, n in sorted(zip(combos, times), key=lambda x: -x[1]):
            need = combo.astype(np.int64)
            n = int(min(n, (supply[need > 0] // need[need > 0]).min()))
            if n <= 0:
                continue
            supply -= n * need
            slot = 0
            for b in np.flatnonzero(need):
                for _ in range(need[b]):
                    placed = 0
                    for ln in range((b + 1) * SLOT, b * SLOT, -1):  # the longest of the slot first
                        if ln >= window:
                            continue
                        take = int(min(count[ln] - used[ln], n - placed))
                        if take > 0:
                            rows.append((ln, int(used[ln]), int(used[ln]) + take, seq + placed, slot, 1))
                            used[ln] += take
                            placed += take
                    slot += 1
            seq += n
    patterns, left = greedy(count - used, window)
    for pattern, repeat in patterns:
        slot = 0
        for ln, times in pattern:
            rows.append((ln, int(used[ln]), int(used[ln]) + times * repeat, seq, slot, times))
            used[ln] += times * repeat
            slot += times
        seq += repeat
    tape, at = {}, 0
    for ln in np.flatnonzero(left)[::-1]:
        width = -(-int(ln) // GRAIN) * GRAIN
        tape[int(ln)] = (int(used[ln]), at, width)
        at += width * int(left[ln])
    out = pd.DataFrame(rows, columns=["length", "lo", "hi", "seq", "slot", "per"]).sort_values(["length", "lo"])
    return out, tape, seq, seq + -(-at // window)


# ---- placing -------------------------------------------------------------------------------------------------
def ranked(measured: DataFrame, window: int) -> DataFrame:
    """Adds ``rest`` (length of the remainder) and ``rank``, 0.. among rows of the same remainder length."""
    salts = partitions(measured.sparkSession)
    rows = measured.withColumn("rest", (F.col("n_tokens") % window).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens", "prefix"), F.lit(salts)).cast("int"))
    small = rows.groupBy("rest", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small.select("rest", "salt", before.alias("base"))
    number = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("doc_id", "n_tokens", "prefix"))
    return rows.withColumn("rn", number).join(starts, ["rest", "salt"]).withColumn("rank", F.col("base") + F.col("rn") - 1).drop("rn", "base", "salt")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: where its tokens come from and where they lie."""
    measured = stored(measure(docs, tokenizer_path, end_id, window), "pack-lengths")
    hist = {r["rest"]: r["count"] for r in measured.groupBy((F.col("n_tokens") % window).cast("int").alias("rest")).count().collect()}
    firsts, total = {}, 0
    for ln in sorted(hist):
        firsts[ln], total = total, total + hist[ln]
    spans, tape, tape_seq, _ = plan({k: v for k, v in hist.items() if k}, window)
    by_length = {ln: g[["lo", "hi", "seq", "slot", "per"]].to_numpy() for ln, g in spans.groupby("length")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, n, crcs, prefix, rest, rank in zip(
                batch["doc_id"].astype("Int64"), batch["n_tokens"], batch["full_crcs"], batch["prefix"], batch["rest"], batch["rank"]
            ):
                doc = None if doc is pd.NA else int(doc)
                for i, crc in enumerate(crcs):  # ids of full windows lie above all others
                    out.append((doc, i * window, window, int(crc), n, ((firsts[rest] + rank + 1) << 22) + i + (1 << 42), 0))
                if not rest:
                    continue
                start, prefix = n - rest, np.frombuffer(bytes(prefix), "<u4")
                table = by_length.get(rest)
                k = int(np.searchsorted(table[:, 0], rank, side="right")) - 1 if table is not None else -1
                if k >= 0 and rank < table[k, 1]:
                    lo, _, seq, slot, per = (int(v) for v in table[k])
                    out.append((doc, start, rest, int(prefix[-1]), n, seq + (rank - lo) // per, slot + (rank - lo) % per))
                    continue
                lo, at, width = tape[rest]
                at += (rank - lo) * width
                done = 0
                while done < rest:
                    seq, offset = divmod(at + done, window)
                    stop = min(rest, done + window - offset)
                    before = int(prefix[done // GRAIN - 1]) if done else 0
                    through = int(prefix[-(-stop // GRAIN) - 1])
                    out.append((doc, start + done, stop - done, crc_of_part(before, through, 4 * (stop - done)), n, tape_seq + seq, offset))
                    done = stop
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]).astype({"doc_id": "Int64"})

    placed = ranked(measured, window).mapInPandas(run, PIECE_SCHEMA)
    # A sequence has at most ``window`` pieces.
    order = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).drop("slot")
