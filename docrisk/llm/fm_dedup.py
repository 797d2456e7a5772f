"""Substring dedup with a compressed FM-index per shard.

A word goes if it lies in a window of ``window`` consecutive words whose word sequence also starts anywhere else.
Windows are routed by content: each has an anchor (the k-gram with the smallest hash), and runs of windows with
the same anchor travel as one segment to the shard of that anchor, so equal windows meet in one shard and no
document is searched in other shards. Only anchors that occur twice are followed, and equal segments are one.

A shard builds an FM-index of its distinct segments (Burrows-Wheeler transform by suffix sorting, packed bit
vectors with rank blocks as wavelet matrix) and streams the segments through it: backward search gives for every
end position the longest match, up to the window, that occurs at two places. Windows that reach the threshold
are reported as intervals. Shards have a planned number of words. Windows of an anchor with more than its share go to
no shard: they are counted by their 128-bit hash, before the shuffle already, and those that occur twice are joined back.

Equal texts: one represents all; with two copies or more every window occurs elsewhere, so no search is needed.
Null and empty texts have no words; texts shorter than the window keep all. Repeated rows count as copies. Extra
columns are ignored. An empty table gives an empty result. Very long texts are cut into segments like any other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.anchors import Rows, anchor_hashes, anchors, shared_texts, with_copies, words_of
from docrisk.llm.common import WordHashes, merge_spans, pieces, signed, stored

WINDOW = 35
GRAM = 12
SHARD_WORDS = 400_000


def kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


# ---- FM-index ------------------------------------------------------------------------------------------------
class Bits:
    """Bit vector packed in 64-bit words with a running count per word."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros(-(-(len(flags) + 1) // 64) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Index of separated word sequences; symbols are 1.. , 0 separates."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        symbols = int(text.max()) + 1
        order = suffix_order(text)
        bwt = text[order - 1]
        self.size = n
        counts = np.bincount(text, minlength=symbols)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.depth = max(1, (symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        row = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        every = np.arange(symbols)
        self.base = first - self._descend(every, np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            ones = self.levels[k].rank(at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol in front."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.base[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def match_lengths(self, text: np.ndarray, ends: np.ndarray, most: int, times: int = 2) -> np.ndarray:
        """Longest suffix of text[:end], up to ``most`` symbols, that the index holds ``times`` times at least."""
        out = np.zeros(len(ends), np.int32)
        live, low, high = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(most):
            at = ends[live] - step - 1
            ok = at >= 0
            symbol = np.where(ok, text[np.maximum(at, 0)], 0)
            ok &= symbol > 0
            live, low, high = live[ok], low[ok], high[ok]
            low, high = self.extend(symbol[ok], low, high)
            ok = high - low >= times
            live, low, high = live[ok], low[ok], high[ok]
            if not len(live):
                break
            out[live] = step + 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each separator is a symbol of its own, so comparisons end at it."""
    n = len(text)
    separators = np.cumsum(text == 0)
    rank = np.where(text == 0, separators - 1, text + int(separators[-1])).astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * np.int64(max(n + int(text.max()), int(rank.max())) + 3) + follow
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


def repeated_windows(blobs: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """Per sequence the starts of windows that occur at two places of the shard."""
    ids: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for blob in blobs:
        words = blob.split(b" ")
        parts.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
        starts.append(at)
        at += len(words) + 1
    text = np.concatenate(parts)
    sizes = [len(p) for p in parts[::2]]
    index = FMIndex(text)
    out: list[np.ndarray] = [np.arange(max(0, n - window + 1)) if c > 1 else None for n, c in zip(sizes, copies)]
    search = [i for i, o in enumerate(out) if o is None]
    ends = [starts[i] + np.arange(window, sizes[i] + 1) for i in search]
    if ends:
        flat = np.concatenate(ends)
        length = np.concatenate([index.match_lengths(text, flat[i : i + 200_000], window) for i in range(0, len(flat), 200_000)])
        cuts = np.cumsum([len(e) for e in ends])[:-1]
        for i, got in zip(search, np.split(length, cuts)):
            out[i] = np.flatnonzero(got >= window)
    return out


# ---- segments ------------------------------------------------------------------------------------------------
def segments(shared: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, k1, k2, start, anchor, h1, h2, n_words, blob): runs of windows with the same shared anchor hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        rows = Rows(["doc_id", "k1", "k2", "start", "anchor", "h1", "h2", "n_words", "blob"])
        for batch in batches:
            docs = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc, k1, k2, text, grams in zip(docs, batch["k1"], batch["k2"], batch["text"], batch["grams"]):
                words = words_of(text)
                h, at = anchor_hashes(words, known, gram, window - gram + 1)
                mine = signed(h[at])
                begins = np.concatenate([[0], np.flatnonzero(mine[1:] != mine[:-1]) + 1])
                stops = np.append(begins[1:], len(mine))
                keep = np.isin(mine[begins], np.asarray(grams, np.int64))
                for a, b, anchor in zip(begins[keep].tolist(), stops[keep].tolist(), mine[begins[keep]].tolist()):
                    blob = b" ".join(words[a : b + window - 1])
                    whole = xxhash.xxh3_128_digest(blob)
                    h1, h2 = struct.unpack("<qq", whole)
                    rows.add((doc, k1, k2, a, anchor, h1, h2, b - a + window - 1, blob), len(blob) + 64)
                yield from rows.frames()
        yield from rows.frames(last=True)

    return shared.mapInPandas(run, "doc_id long, k1 long, k2 long, start int, anchor long, h1 long, h2 long, n_words int, blob binary")


def hot_anchors(distinct: DataFrame, hot_words: int) -> DataFrame:
    """(anchor) of the anchors whose distinct segments hold more than ``hot_words`` words; stored."""
    load = distinct.groupBy("anchor").agg(F.sum("n_words").alias("w")).where(F.col("w") > hot_words)
    return stored(load.select("anchor"), "fm-hot")


def routed(cold: DataFrame, shards: int) -> DataFrame:
    """(shard, h1, h2, base, copies, blob) of the segments of anchors that are not hot."""
    return cold.select(F.pmod("anchor", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", F.lit(0).alias("base"), "copies", "blob")


def hot_windows(segs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, starts) of windows of ``segs`` (distinct, of hot anchors) that occur twice, a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Rows(["h1", "h2", "base", "copies", "w1", "w2"])
        for batch in batches:
            for h1, h2, copies, blob in zip(batch["h1"], batch["h2"], batch["copies"], batch["blob"]):
                words = bytes(blob).split(b" ")
                for i in range(len(words) - window + 1):
                    rows.add((h1, h2, i, copies, *struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words[i : i + window])))))
                    yield from rows.frames()
        yield from rows.frames(last=True)

    windows = stored(segs.mapInPandas(run, "h1 long, h2 long, base int, copies long, w1 long, w2 long"), "fm-windows")
    # Stored, so that both sides of the join are plain exchanges and a window of very many segments can be split.
    often = stored(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2"), "fm-often")
    return windows.join(often, ["w1", "w2"], "left_semi").select("h1", "h2", F.array("base").alias("starts"))


def repeated(distinct: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(h1, h2, starts): repeated windows of every distinct segment, from the index of its shard or by count."""
    total = distinct.agg(F.sum("n_words")).first()[0] or 0
    shards = pieces(total, shard_words)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(b) for b in group["blob"]], group["copies"].tolist(), window)
        out = group[["h1", "h2"]].assign(starts=[(f + b).astype(np.int32) for f, b in zip(found, group["base"])])
        return out[out["starts"].map(len) > 0]

    hot = hot_anchors(distinct, 2 * shard_words)
    if hot.isEmpty():
        cold, counted = distinct, None
    else:
        cold = distinct.join(hot, "anchor", "left_anti")
        counted = hot_windows(distinct.join(hot, "anchor", "left_semi"), window)
    # As many partitions as shards at least, so that tasks hold a shard each.
    out = routed(cold, shards).groupBy("shard").applyInPandas(run, "h1 long, h2 long, starts array<int>")
    return out if counted is None else out.unionByName(counted)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) per row; spans are word intervals that go."""
    marked = stored(
        with_copies(stored(anchors(docs, gram, window - gram + 1, kept_hash, "string"), "fm-anchors")), "fm-marked"
    )
    shared = shared_texts(docs, marked, "fm-texts")
    segs = stored(segments(shared, window, gram), "fm-segments")
    distinct = segs.groupBy("anchor", "h1", "h2", "n_words").agg(F.count("*").alias("copies"), F.min("blob").alias("blob"))
    places = segs.select("doc_id", "k1", "k2", "start", "h1", "h2").join(repeated(distinct, window, shard_words), ["h1", "h2"])
    spans = places.groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("start", "starts")).alias("found"))  # a document's own
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "found")
    same = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_d"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, text, found in zip(batch["k1"], batch["k2"], batch["text"], batch["found"]):
                words = words_of(text)
                merged = merge_spans([(f["start"] + int(s), f["start"] + int(s) + window) for f in found for s in f["starts"]])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((k1, k2, len(words) - len(kept), kept_hash(kept), [{"start": a, "stop": b} for a, b in merged]))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_removed", "sha", "spans"])

    span_type = "array<struct<start:int,stop:int>>"
    fixed = shared.join(spans, same).mapInPandas(cut, f"k1 long, k2 long, n_removed long, sha string, spans {span_type}").dropDuplicates(["k1", "k2"])
    copied = marked.where("copies > 1")
    all_gone = F.col("n_words") >= window
    out_copied = copied.select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(all_gone, F.lit(kept_hash([]))).otherwise(F.col("extra")).alias("kept_sha256"),
        F.when(all_gone, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))).otherwise(F.array().cast(span_type)).alias("spans"),
    )
    out_single = marked.where("copies = 1").join(fixed, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "extra").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast(span_type)).alias("spans"),
    )
    return out_single.unionByName(out_copied)
