"""Helpers shared by the corpus operators: stored tables, word hashes, n-grams, minimisers."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk.session import work_folder

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads committed files, so a lost executor costs no recomputation
    and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, changed until they clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a whole text (null counts as empty)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(7), whole).alias("k2")]


class WordHashes(dict):
    """64-bit hash of a word, remembered for the frequent ones; bounded size."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + words[i : i + count]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; a text with fewer words is one shingle, one without has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(words, min(n, len(words))))


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` n-grams the position of its smallest hash, the first on ties."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    step = max(1, 4_000_000 // width)  # bounded scratch for very long texts
    parts = [view[i : i + step].argmin(axis=1) for i in range(0, len(view), step)]
    return np.concatenate(parts).astype(np.int64) + np.arange(len(view))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def pieces(total: int, each: int) -> int:
    """Number of parts of at most ``each``; one at least."""
    return max(1, math.ceil(total / each))
