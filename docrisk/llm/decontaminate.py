"""Benchmark decontamination: which documents contain a (short) test item.

Size-partitioned MinHash containment search. Items are sets of five-word shingles, partitioned by size in
powers of two. An item's signature is its ``k`` smallest shingle hashes, so each signature hash lies in a
document with the probability of the containment, however long the document is; and in a partition of large
items only shingles below the partition's cut can belong to a signature, so most of a document is not looked
up. A pair that shares enough signature hashes is a candidate; the share asked for is so far below the
threshold that a true pair is missed with a probability under 1e-6 (never for items of at most k shingles).
Candidates are verified by the exact containment of the whole shingle sets (as 64-bit hashes).

Documents are read once. Shingles are tested against bit tables of the items' hashes, which have a fixed
largest size (``MAX_BITS``); with more items than they suit, more shingles pass to the join, none is lost.

Items with fewer than five words are one shingle of that length. Null, empty and wordless texts and items match
nothing. Repeated rows and equal ids count as one document for reporting. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.common import apart, ngram_hashes, signed, stored, text_key, WordHashes

SHINGLE = 5
THRESHOLD = 0.8
SIGNATURE = 32
MAX_BITS = 1 << 26
_WORDS = re.compile(r"\w+")


def hashes_of(text: str | None, known: WordHashes, n: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Word hashes of a lower-cased text, and the shingle length it takes as an item."""
    words = known.of(_WORDS.findall((text or "").lower()))
    return words, min(n, len(words))


def item_shingles(items: DataFrame, k: int = SIGNATURE, n: int = SHINGLE) -> DataFrame:
    """(item_id, n, size, part, hash, cut): a row for each distinct shingle; ``cut`` is the largest signature hash of the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                words, length = hashes_of(text, known, n)
                if not length:
                    continue
                h = np.unique(signed(ngram_hashes(words, length)))
                yield pd.DataFrame({"item_id": item, "n": length, "size": len(h), "part": len(h).bit_length(), "hash": h, "cut": h[min(k, len(h)) - 1]})

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInPandas(
        run, "item_id long, n int, size long, part int, hash long, cut long"
    )


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """``bits`` flags (a power of two) as 64-bit words; reduced by slot before it reaches the driver."""
    slot = F.shiftrightunsigned("hash", 64 - (bits.bit_length() - 1))
    words = hashes.select(slot.alias("s")).selectExpr("shiftright(s, 6) as w", "shiftleft(1L, cast(s & 63 as int)) as b")
    table = np.zeros(bits // 64, np.uint64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most bits / 64 rows
    table[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return table


def passing(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def probe(docs: DataFrame, shingles: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Per document the shingle hashes that may belong to an item: of signatures (``sig``) and of whole items (``every``)."""
    facts = shingles.agg(F.count("*").alias("c"), F.collect_set("n").alias("lengths")).first()  # at most ``n`` lengths
    lengths = sorted(facts["lengths"]) or [n]
    bits = 1 << max(12, min(MAX_BITS.bit_length() - 1, (16 * facts["c"]).bit_length()))
    # Signature hashes of a partition lie below its cut.
    cuts = {(r["n"], r["part"]): r["cut"] for r in shingles.groupBy("n", "part").agg(F.max("cut").alias("cut")).collect()}
    every = bit_table(shingles, bits)
    parts = []
    for (length, part), cut in sorted(cuts.items()):
        of_part = shingles.where((F.col("n") == length) & (F.col("part") == part) & (F.col("hash") <= F.col("cut")))
        parts.append((length, cut, bit_table(of_part, bits)))
    by_length: dict[int, list] = {}
    for length, cut, table in parts:
        by_length.setdefault(length, []).append((cut, table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for doc, k1, k2, text in zip(batch["doc_id"].astype("Int64"), batch["k1"], batch["k2"], batch["text"]):
                words, _ = hashes_of(text, known, n)
                sig, full = [], []
                for length in lengths:
                    h = signed(ngram_hashes(words, length))
                    h = h[passing(every, h)]
                    if not len(h):
                        continue
                    h = np.unique(h)
                    full.append(h)
                    for cut, table in by_length.get(length, ()):
                        low = h[h <= cut]
                        sig.append(low[passing(table, low)])
                if full:
                    rows.append((None if doc is pd.NA else int(doc), k1, k2, np.unique(np.concatenate(sig)) if sig else [], np.unique(np.concatenate(full))))
            out = pd.DataFrame(rows, columns=["doc_id", "k1", "k2", "sig", "every"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
    return keyed.mapInPandas(run, "doc_id long, k1 long, k2 long, sig array<long>, every array<long>")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SIGNATURE, n: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, item_id, size, n_shared, share) of all texts and items with containment of the item >= threshold."""
    shingles = stored(item_shingles(items, k, n), "items")
    found = stored(probe(docs, shingles, n), "probes")
    # Half of the expected share: far in the tail for any pair at the threshold.
    need = F.ceil(F.least(F.col("size"), F.lit(k)) * (threshold / 2))
    signatures = shingles.where(F.col("hash") <= F.col("cut")).select("item_id", "size", "hash")
    candidates = (
        found.select("doc_id", "k1", "k2", F.explode("sig").alias("hash")).join(signatures, "hash")
        .groupBy("doc_id", "k1", "k2", "item_id", "size").agg(F.count("*").alias("hits")).where(F.col("hits") >= need)
    )
    pair = candidates.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), "item_id", "size")
    pairs = found.join(pair, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    exact = (
        pairs.select("doc_id", "k1", "k2", "item_id", "size", F.explode("every").alias("hash"))
        .join(shingles.select("item_id", "hash"), ["item_id", "hash"])
        .groupBy("doc_id", "k1", "k2", "item_id", "size").agg(F.countDistinct("hash").alias("n_shared"))
    )
    return exact.withColumn("share", F.col("n_shared") / F.col("size")).where(F.col("share") >= threshold)


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SIGNATURE, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs with containment of the item >= threshold."""
    return (
        contained(docs, items, threshold, k, n).groupBy("doc_id", "item_id")
        .agg(F.max("n_shared").alias("n_shared"), F.max("size").alias("n_shingles"), F.max("share").alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item. Rows with the same doc_id are one document; without one, each text is."""

    names = apart(docs, "nameless", "id_or_k1", "k2_or_0")

    def document(doc_id, k1, k2) -> list:
        nameless = doc_id.isNull()
        return [c.alias(n) for c, n in zip((nameless, F.coalesce(doc_id, k1), F.when(nameless, k2).otherwise(0)), names)]

    hit = contained(docs, items, threshold).select(*document(F.col("doc_id"), F.col("k1"), F.col("k2"))).distinct()
    own = docs.select("*", *document(F.col("doc_id").cast("long"), *text_key(F.col("text"))))
    return own.join(hit, names, "left_anti").select(*docs.columns)
