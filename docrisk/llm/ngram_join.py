"""N-gram Jaccard join: pairs of texts whose five-word shingle sets are at least 0.8 alike, and their classes.

MinHash banding proposes: bands and rows are chosen for a target recall at the threshold, texts meet on band
hashes. The texts of a bucket are linked to its smallest one only; connected texts form a candidate group, and
every true pair that shares a band is inside one group. A group is verified completely on full shingle sets, in
blocks: texts are classed by set size (sizes of a true pair differ by a quarter at most, so only equal and
neighbouring classes meet), classes are cut into blocks of bounded size, and a task compares two blocks by
counting shared shingles. A task returns, per text, its number of links and one tie to its local component, never
the pairs. So no bucket is capped and no task holds a group.

Rows: equal texts are one text; different texts with equal shingle sets are compared once. ``n_links`` counts the
other different texts a text is linked to. ``class_id`` is the smallest doc_id of the texts connected by links.

Null and empty texts and texts without words link to nothing; equal ones share a class. A text of fewer than five
words is one shingle. Repeated rows count as copies; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.anchors import keyed
from docrisk.llm.common import WordHashes, apart, mix, partitions, shingle_set, signed, stored, text_key
from docrisk.llm.components import of_members

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9998
BLOCK_SHINGLES = 300_000
BLOCK_TEXTS = 1000
_WORDS = re.compile(r"\w+")


def band_plan(threshold: float, recall: float, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the longest bands with which ``most`` hashes reach ``recall`` at the threshold."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Bander:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 2**63, n, np.uint64)[:, None]
        self.odd = (rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.odd), np.uint64(2**64 - 1))
        for i in range(0, len(shingles), 4096):  # bounded scratch for very long texts
            low = np.minimum(low, ((shingles[None, i : i + 4096] ^ self.xor) * self.odd).min(axis=1))
        table = mix(low).reshape(self.bands, self.rows)
        out = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + table[:, r])
        return out


def shingles_of(text: str, known: WordHashes, n: int) -> np.ndarray:
    return shingle_set(known.of(_WORDS.findall(text.lower())), n)


def sketches(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, k1, k2, node, bands): node stands for the shingle set, for wordless texts for the text itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, bander = WordHashes(), Bander(bands, rows)
        for batch in batches:
            node, found = [], []
            for text, k1 in zip(batch["text"], batch["k1"]):
                s = shingles_of(text, known, n)
                node.append(int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else k1)
                found.append(signed(bander.of(s)) if len(s) else [])
            out = batch[["doc_id", "k1", "k2"]].assign(node=node, bands=found)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return keyed(docs).mapInPandas(run, "doc_id long, k1 long, k2 long, node long, bands array<long>")


# ---- verification --------------------------------------------------------------------------------------------
def shared_counts(sets: list[np.ndarray], dense_from: int = 48) -> np.ndarray:
    """Matrix of the numbers of shared shingles of all sets of a block pair."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    all_ = np.concatenate(sets)
    order = np.argsort(all_, kind="stable")
    all_, who = all_[order], who[order]
    starts = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    df = np.diff(np.append(starts, len(all_)))
    out = np.zeros((m, m), np.float32)
    frequent = np.repeat(df > dense_from, df)
    rare_h, rare_w = all_[~frequent], who[~frequent]
    flat = np.zeros(m * m, np.int64)
    for k in range(1, dense_from):
        hit = np.flatnonzero(rare_h[k:] == rare_h[:-k]) if len(rare_h) > k else ()
        if not len(hit):
            break
        flat += np.bincount(rare_w[hit] * m + rare_w[hit + k], minlength=m * m)
    out += flat.reshape(m, m)
    out += out.T.copy()
    often_w, often_c = who[frequent], np.repeat(np.arange((df > dense_from).sum()), df[df > dense_from])
    columns = int((df > dense_from).sum())
    for c in range(0, columns, 2048):
        here = (often_c >= c) & (often_c < c + 2048)
        table = np.zeros((m, min(2048, columns - c)), np.float32)
        table[often_w[here], often_c[here] - c] = 1
        out += table @ table.T
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each local component of a boolean matrix."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify_block(rows: list[tuple], same: bool, threshold: float) -> list[tuple]:
    """(node, n_links, tie) for the nodes with links; rows are (node, side, n_texts, set), compared across sides."""
    seen: dict[int, tuple] = {}
    for r in rows:
        seen[r[0]] = r
    rows = list(seen.values())
    if len(rows) < 2:
        return []
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.float64)
    both = shared_counts(sets)
    linked = both + 1e-6 >= threshold * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if not same:
        side = np.array([r[1] for r in rows])
        linked &= side[:, None] != side[None, :]
    weight = linked @ np.array([r[2] for r in rows], np.float64)
    root = local_roots(linked)
    return [(r[0], int(w), rows[k][0]) for r, w, k, any_ in zip(rows, weight, root, linked.any(axis=1)) if any_]


def block_tasks(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``sets`` (node, grp, n_texts, size, shingles) for every pair of blocks they take part in."""
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold) + 1e-9)).cast("int")
    rows = sets.withColumn("c", size_class)
    load = rows.groupBy("grp", "c").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    blocks = load.select("grp", "c", F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int").alias("nb"))
    # Blocks of the class itself and of its two neighbours, as one small row per class.
    near = blocks.select("grp", F.explode(F.array(*[F.struct((F.col("c") + d).alias("c"), F.lit(-d).alias("d"), F.col("nb").alias("k")) for d in (-1, 0, 1)])).alias("x")).select("grp", "x.*")
    count = lambda d: F.coalesce(F.max(F.when(F.col("d") == d, F.col("k"))), F.lit(0))
    around = near.groupBy("grp", "c").agg(count(-1).alias("below"), count(0).alias("nb"), count(1).alias("above")).where("nb > 0")
    joined = rows.join(around, ["grp", "c"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    keys = """concat(
      transform(sequence(0, nb - 1), x -> named_struct('ca', c, 'ba', least(blk, x), 'cb', c, 'bb', greatest(blk, x), 'side', int(blk > x))),
      if(above > 0, transform(sequence(0, greatest(above, 1) - 1), x -> named_struct('ca', c, 'ba', blk, 'cb', c + 1, 'bb', x, 'side', 0)), array()),
      if(below > 0, transform(sequence(0, greatest(below, 1) - 1), x -> named_struct('ca', c - 1, 'ba', x, 'cb', c, 'bb', blk, 'side', 1)), array()))"""
    return joined.select("grp", "node", "n_texts", "shingles", F.explode(F.expr(keys)).alias("t")).select("grp", "t.*", "node", "n_texts", "shingles")


def verified(tasks: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links, tie) per text and block pair; a partition streams its block pairs one after another."""
    keys = ["grp", "ca", "ba", "cb", "bb"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(zip(*(batch[k] for k in keys)), batch["node"], batch["side"], batch["n_texts"], map(bytes, batch["shingles"]))

        out = []
        for key, group in groupby(rows(), key=lambda r: r[0]):
            out += verify_block([r[1:] for r in group], key[1:3] == key[3:5], threshold)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["node", "n_links", "tie"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["node", "n_links", "tie"])

    dealt = tasks.repartition(partitions(tasks.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "node long, n_links long, tie long")


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(doc_id, k1, k2, class_id, n_links, label) per row of ``docs``; k1 and k2 are the text's hashes.

    ``label`` names the class by a node of it: also classes without doc_id, or that share one, have labels of their own.
    """
    bands, rows = band_plan(threshold, recall)
    sketched = stored(sketches(docs, bands, rows, n), "join-sketches")
    texts = sketched.groupBy("node", "k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("doc_id"))
    nodes = stored(
        texts.groupBy("node").agg(
            F.count("*").alias("n_texts"), F.sum("n_docs").alias("n_docs"), F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "k1", "k2")).alias("rep"),
        ),
        "join-nodes",
    )
    buckets = sketched.select("node", F.explode("bands").alias("bucket")).distinct()
    lead = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead")
    groups = stored(of_members(buckets.join(lead, "bucket"), "node", "lead"), "join-groups")

    chosen = groups.join(nodes, "node").select("node", F.col("label").alias("grp"), "n_texts", F.col("rep.doc_id").alias("_d"), F.col("rep.k1").alias("_1"), F.col("rep.k2").alias("_2"))
    same = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_d"))

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            found = [shingles_of(t, known, n) for t in batch["text"]]
            yield batch[["node", "grp", "n_texts"]].assign(size=[len(s) for s in found], shingles=[s.tobytes() for s in found])

    sets = stored(keyed(docs).join(chosen, same).select("node", "grp", "n_texts", "text").mapInPandas(full_sets, "node long, grp long, n_texts long, size long, shingles binary"), "join-sets")
    links = stored(verified(block_tasks(sets, threshold), threshold), "join-links")
    classes = of_members(links, "node", "tie")
    counted = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of_node = nodes.join(counted, "node", "left").join(classes, "node", "left").select(
        "node", "first", "n_docs", (F.coalesce("n_links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"),
    )
    smallest = of_node.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("n_docs").alias("size")).where("size > 1").select("label", "class_id")
    placed = of_node.join(smallest, "label").select("node", "label", "class_id", "n_links")
    # Wordless texts are nodes of their own text and have no links.
    out = sketched.withColumn("wordless", F.size("bands") == 0).select("doc_id", "k1", "k2", "node", "wordless").join(placed, "node", "left")
    return out.select(
        "doc_id", "k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.when(F.col("wordless"), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("label", "node").alias("label"),
    )


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without near-duplicates: of every class the row with the smallest doc_id stays.

    Rows without doc_id stay only if their class has no row with one; of repeated rows one stays. Classes are
    told apart by their texts, so different texts without doc_id or with the same one do not replace each other.
    """
    found = join(docs, threshold)
    d, a, b, k1, k2 = apart(docs, "keep_id", "keep_1", "keep_2", "text_1", "text_2")
    keep = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("r")).select(
        F.col("r.doc_id").alias(d), F.col("r.k1").alias(a), F.col("r.k2").alias(b)
    )
    one, two = text_key(F.col("text").cast("string"))
    hashed = docs.withColumns({k1: one, k2: two})
    same = (F.col(k1) == F.col(a)) & (F.col(k2) == F.col(b)) & F.col("doc_id").eqNullSafe(F.col(d))
    return hashed.join(keep, same, "left_semi").dropDuplicates(["doc_id", k1, k2]).select(*docs.columns)
