"""Content-selected anchor positions of texts, and those that occur in more than one place.

Words are runs of non-blank bytes. In every run of ``width`` consecutive k-grams the one with the smallest hash
is an anchor, so two equal passages of ``k + width - 1`` words have an anchor at the same place. Texts without
an anchor that occurs elsewhere cannot share such a passage, and go no further.

Equal texts are represented by one of them (smallest doc_id), before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.common import WordHashes, ngram_hashes, signed, stored, text_key, window_minima


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII blanks (space and 0x09 to 0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text) with nulls as empty texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))


def anchor_hashes(words: list[bytes], known: WordHashes, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams, and for every run of ``width`` of them the position of the anchor."""
    h = ngram_hashes(known.of(words), k)
    return h, window_minima(h, width)


def anchors(docs: DataFrame, k: int, width: int, extra=None, extra_schema: str = "") -> DataFrame:
    """(doc_id, k1, k2, n_words, grams, times) per row: distinct anchor hashes and at how many places each is one.

    ``extra(words)`` adds a column from the same reading.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            n, grams, times, more = [], [], [], []
            for text in batch["text"]:
                words = words_of(text)
                h, at = anchor_hashes(words, known, k, width)
                found, count = np.unique(h[np.unique(at)], return_counts=True)
                n.append(len(words))
                grams.append(signed(found))
                times.append(count.astype(np.int32))
                if extra:
                    more.append(extra(words))
            out = batch[["doc_id", "k1", "k2"]].assign(n_words=n, grams=grams, times=times)
            out["doc_id"] = out["doc_id"].astype("Int64")
            if extra:
                out["extra"] = more
            yield out

    schema = "doc_id long, k1 long, k2 long, n_words long, grams array<long>, times array<int>" + (f", extra {extra_schema}" if extra else "")
    return keyed(docs).mapInPandas(run, schema)


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copies`` (rows with the same text) and ``is_rep``; only groups of two or more take part in the join."""
    groups = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where(F.col("n") > 1)
    joined = rows.join(groups, ["k1", "k2"], "left")
    is_rep = F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))
    return joined.withColumn("copies", F.coalesce("n", F.lit(1).cast("long"))).withColumn("is_rep", is_rep).drop("n", "rep")


def shared_grams(marked: DataFrame, name: str) -> DataFrame:
    """(doc_id, k1, k2, grams): anchor hashes of representatives that occur at two places at least.

    A text has one row per hash, however often it repeats it. The hashes that count are stored, so that both
    sides of the join are plain exchanges and an adaptive plan can split a hash that very many texts have.
    """
    reps = marked.where("is_rep").select("doc_id", "k1", "k2", F.explode(F.arrays_zip("grams", "times")).alias("a"))
    seen = reps.select("doc_id", "k1", "k2", F.col("a.grams").alias("gram"), F.col("a.times").alias("times"))
    often = stored(seen.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram"), name)
    return seen.select("doc_id", "k1", "k2", "gram").join(often, "gram", "left_semi").groupBy("doc_id", "k1", "k2").agg(F.collect_list("gram").alias("grams"))


def shared_texts(docs: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """(doc_id, k1, k2, text, grams) of representatives with shared anchors, stored."""
    grams = shared_grams(marked, f"{name}-grams").select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "grams")
    same = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return stored(keyed(docs).join(grams, same).drop("_d", "_1", "_2"), name)


class Rows:
    """Output rows gathered in column lists and handed on in frames of bounded bytes."""

    def __init__(self, columns: list[str], most: int = 4 << 20):
        self.columns, self.most = columns, most
        self._new()

    def _new(self) -> None:
        self.rows, self.held = [], 0

    def add(self, row: tuple, size: int = 64) -> None:
        self.rows.append(row)
        self.held += size

    def frames(self, last: bool = False) -> Iterator[pd.DataFrame]:
        if self.rows and (last or self.held >= self.most):
            out = pd.DataFrame(self.rows, columns=self.columns)
            if "doc_id" in self.columns:
                out["doc_id"] = out["doc_id"].astype("Int64")
            self._new()
            yield out
