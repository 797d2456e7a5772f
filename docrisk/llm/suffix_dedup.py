"""Suffix-array dedup: repeated passages by a sparse suffix array.

Suffixes are retained at minimiser positions only: in every run of 26 consecutive 25-grams of words the one with
the smallest hash. Two equal passages of ``min_words`` (50) words have such a position in common. Positions whose
25-gram occurs nowhere else are left out. The rest are sorted by their text (range partitioning with the words
to their left, document and position as ties, so that one common passage fills many tasks), neighbours in that
order are compared, and each match is extended to the right and to the left. Overlapping matches of a document
merge, so a passage of any length is reported whole. The last row of a partition meets the first of the next
in a second, small comparison.

Neighbours share most to the right, but a closer one can share less to the left. So rows with the same 25-gram form a
group, and every passage of ``min_words`` around its anchor is compared in the whole group: at once where the group
lies inside a partition and has at most ``GROUP`` rows, else by the hashes of its passages. Rows whose neighbour before
has the same passage send nothing. The result is exact: a word is reported if and only if a passage of ``min_words``
around it occurs elsewhere.

Equal texts are represented by one; with two copies the whole text (of ``min_words`` or more) is a repeated passage.
Null, empty and short texts have no spans; repeated rows count as copies; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.llm.anchors import Rows, anchor_hashes, anchors, shared_texts, with_copies, words_of
from docrisk.llm.common import WordHashes, merge_spans, partitions, signed, stored

MIN_WORDS = 50
GROUP = 2000
# Words are joined by the tab, and the bytes below it are escaped, so that rows that share words are next to each other.
_LOW = re.compile(rb"[\x00-\x08\x0e]")
_SPAN = "array<struct<start:int,stop:int>>"


def suffixes(shared: DataFrame, min_words: int) -> DataFrame:
    """(suffix, left, doc_id, k1, k2, spot): up to ``min_words`` to either side of a shared position; ``left`` runs backwards."""
    half = min_words // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        rows = Rows(["suffix", "left", "spot", "doc_id", "k1", "k2"])
        for batch in batches:
            docs = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for doc, k1, k2, text, grams in zip(docs, batch["k1"], batch["k2"], batch["text"], batch["grams"]):
                words = words_of(text)
                h, at = anchor_hashes(words, known, half, min_words - half + 1)
                at = np.unique(at)
                if _LOW.search(text.encode("utf-8", "surrogatepass")):
                    words = [_LOW.sub(lambda m: b"\x0e" + bytes([m[0][0] + 0x30]), w) for w in words]
                for p in at[np.isin(signed(h[at]), np.asarray(grams, np.int64))].tolist():
                    suffix, left = b"\t".join(words[p : p + min_words]), b"\t".join(words[max(0, p - half) : p][::-1])
                    rows.add((suffix, left, p, doc, k1, k2), len(suffix) + len(left) + 64)
                yield from rows.frames()
        yield from rows.frames(last=True)

    return shared.mapInPandas(run, "suffix binary, left binary, spot int, doc_id long, k1 long, k2 long")


def common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def parsed(row: tuple) -> tuple:
    """(suffix, left, spot, doc_id, k1, k2) with lists of words."""
    return row[0].split(), row[1].split(), *row[2:]


def neighbour_spans(rows: list[tuple], min_words: int) -> Iterator[tuple]:
    """(doc_id, k1, k2, start, stop) of every row of a sorted run that matches a neighbour long enough."""
    rows = list(map(parsed, rows))
    for before, now in zip(rows, rows[1:]):
        yield from pair_spans(before, now, common(before[0], now[0]), common(before[1], now[1]), min_words)


def pair_spans(before: tuple, now: tuple, right: int, back: int, min_words: int) -> Iterator[tuple]:
    if right and right + back >= min_words:
        for r in (before, now):
            yield r[3], r[4], r[5], r[2] - back, r[2] + right


def group_spans(rows: list[tuple], ties: list[tuple[int, int]], min_words: int) -> Iterator[tuple]:
    """Spans of passages of a whole group that rows share which are not neighbours; ``ties`` has (right, back) of neighbours."""
    half = min_words // 2
    # Only where the left side breaks twice can a passage return after other ones.
    breaks = sorted(max(min_words - right, back + 1) for right, back in ties if back < half)
    if len(breaks) < 2:
        return
    for size in range(max(1, breaks[1]), half + 1):
        runs: dict[tuple, int] = defaultdict(int)
        holders = []
        lefts = [tuple(r[1][:size]) for r in rows]
        block = 0
        for i, row in enumerate(rows):
            right, back = ties[i - 1] if i else (0, 0)
            joined = i > 0 and right >= min_words - size
            block += not joined
            if len(lefts[i]) == size and len(row[0]) >= min_words - size and not (joined and back >= size):
                runs[block, lefts[i]] += 1
                holders.append((i, block))
        for i, b in holders:
            if runs[b, lefts[i]] > 1:
                r = rows[i]
                yield r[3], r[4], r[5], r[2] - size, r[2] - size + min_words
        if len(set(lefts)) == len(rows):  # nor can longer left sides be equal
            return


def passages(row: tuple, tie: tuple[int, int] | None, min_words: int) -> Iterator[tuple]:
    """(doc_id, k1, k2, start, stop, h1, h2) of the passages around an anchor that the row before does not have."""
    suffix, left, spot, doc, k1, k2 = row
    for size in range(max(0, min_words - len(suffix)), min(len(left), min_words // 2) + 1):
        if tie is None or tie[0] < min_words - size or tie[1] < size:
            whole = b" ".join(left[:size][::-1] + suffix[: min_words - size])
            yield doc, k1, k2, spot - size, spot - size + min_words, *struct.unpack("<qq", xxhash.xxh3_128_digest(whole))


def matches(sorted_rows: DataFrame, min_words: int, most: int = GROUP) -> DataFrame:
    """Spans found inside each partition, its first and last row (``edge``) for the comparison across partitions, and
    passages with hashes of groups that other partitions may hold too or that have more than ``most`` rows."""
    half = min_words // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, now = TaskContext.get().partitionId(), None, None
        columns = ["suffix", "left", "spot", "doc_id", "k1", "k2"]
        every = [*columns, "start", "stop", "edge", "h1", "h2"]
        spans, sent = [], []
        # Rows and ties of the group at hand; an open group is sent, not held. The first may have begun in another partition.
        group, ties, is_open = [], [], True

        def edge(row, side):
            return pd.DataFrame([(*row, None, None, 2 * part + side, None, None)], columns=every)

        def send_group():
            for row, tie in zip(group, [None, *ties]):
                sent.extend(passages(row, tie, min_words))

        def frames(least):
            for rows, names in ((spans, ["doc_id", "k1", "k2", "start", "stop"]), (sent, ["doc_id", "k1", "k2", "start", "stop", "h1", "h2"])):
                if len(rows) >= least:
                    yield pd.DataFrame(rows, columns=names).reindex(columns=every).astype({x: "Int64" for x in every[2:]}).astype({"suffix": object, "left": object})
                    rows.clear()

        for batch in batches:
            if not len(batch):
                continue
            docs = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            for raw in zip(map(bytes, batch["suffix"]), map(bytes, batch["left"]), batch["spot"], docs, batch["k1"], batch["k2"]):
                before, now = now, parsed(raw)
                if before is None:
                    yield edge(raw, 0)
                    tie = None
                else:
                    right, back = tie = common(before[0], now[0]), common(before[1], now[1])
                    spans.extend(pair_spans(before, now, right, back, min_words))
                    if right < half:
                        if not is_open:
                            spans.extend(group_spans(group, ties, min_words))
                        group, ties, is_open, tie = [], [], False, None
                if is_open:
                    sent.extend(passages(now, tie, min_words))
                else:
                    group.append(now)
                    if tie:
                        ties.append(tie)
                    if len(group) > most:
                        send_group()
                        group, ties, is_open = [], [], True
                last = raw
                yield from frames(20_000)
        send_group()  # the last may go on in another partition
        yield from frames(1)
        if last is not None:
            yield edge(last, 1)

    return sorted_rows.mapInPandas(
        run, "suffix binary, left binary, spot int, doc_id long, k1 long, k2 long, start int, stop int, edge int, h1 long, h2 long"
    )


def returning(sent: DataFrame) -> DataFrame:
    """Rows of ``sent`` whose passage is at another place, too (two anchors may send the same place).

    The hashes that count are stored, so that the join can be split.
    """
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "start") for f in (F.min, F.max)]
    often = stored(sent.groupBy("h1", "h2").agg(*ends).where("min_k1 <> max_k1 or min_start <> max_start").select("h1", "h2"), "suffix-returning")
    return sent.join(often, ["h1", "h2"], "left_semi")


def across(edges: DataFrame, min_words: int) -> DataFrame:
    """Spans between the last row of a partition and the first of the next one that has rows; two rows per partition in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            batch["doc_id"] = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            rows += [(e, bytes(s), bytes(left), p, d, a, b) for e, s, left, p, d, a, b in zip(*(batch[c] for c in ("edge", "suffix", "left", "spot", "doc_id", "k1", "k2")))]
        rows.sort(key=lambda r: r[0])
        found = [f for a, b in zip(rows[1::2], rows[2::2]) for f in neighbour_spans([a[1:], b[1:]], min_words)]
        yield pd.DataFrame(found, columns=["doc_id", "k1", "k2", "start", "stop"]).astype({"doc_id": "Int64"})

    return edges.coalesce(1).mapInPandas(run, "doc_id long, k1 long, k2 long, start int, stop int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, most: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans) of the rows that hold a repeated passage; spans are word intervals."""
    half = min_words // 2
    marked = stored(with_copies(stored(anchors(docs, half, min_words - half + 1), "suffix-anchors")), "suffix-marked")
    shared = shared_texts(docs, marked, "suffix-texts")
    n = partitions(docs.sparkSession)
    order = ["suffix", "left", "k1", "doc_id", "spot"]
    ranged = suffixes(shared, min_words).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stored(matches(ranged, min_words, most), "suffix-matches")
    columns = ["doc_id", "k1", "k2", "start", "stop"]
    spans = found.where("edge is null and h1 is null").select(*columns).unionByName(across(found.where("edge is not null"), min_words))
    spans = spans.unionByName(returning(found.where("h1 is not null")).select(*columns))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            merged = [merge_spans([(int(x["start"]), int(x["stop"])) for x in f]) for f in batch["found"]]
            out = batch[["k1", "k2"]].assign(n_repeated=[sum(b - a for a, b in m) for m in merged])
            out["spans"] = [[{"start": a, "stop": b} for a, b in m] for m in merged]
            yield out

    by_text = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))  # a text's own
    by_text = by_text.mapInPandas(merge, f"k1 long, k2 long, n_repeated long, spans {_SPAN}")
    single = marked.where("copies = 1").join(by_text, ["k1", "k2"]).select("doc_id", "n_words", "n_repeated", "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))).cast(_SPAN)
    copied = marked.where((F.col("copies") > 1) & (F.col("n_words") >= min_words)).select("doc_id", "n_words", F.col("n_words").alias("n_repeated"), whole.alias("spans"))
    return single.unionByName(copied)
