"""Prefix trie of conversations, built as burst tries.

Every turn has an id (a 128-bit hash of role and text), every conversation is the sequence of its turns' ids, written as
the chained hashes of its prefixes: equal prefixes, and only these, have equal hashes, and sequences sorted by them come
in trie order. Conversations of equal sequences are one row with a count. Texts do not travel: a turn is 16 bytes and
the size of its text.

1. Burst. All sequences begin in one container under the root. A container of more than ``container`` sequences bursts:
   its sequences move to containers under longer trie heads, by the next turn's id; each round bursts twice as many
   turns as the round before, so that a long passage that many share takes few rounds. Sequences that end before
   stay under the head that is their own end. Containers are counted with map-side partial sums, never gathered.
2. Sweep. Each remaining container is sorted and swept once with a stack of open nodes, as a stream: nodes below its
   head come out complete, since all sequences through them lie in it, and one summary row (members, leaves, sums).
3. Heads. The nodes at and above the heads are sums over the summaries of the containers under them.

Memory of a task is that of one sequence and its open nodes. What the hash of a node's end ids needs is sorted by range,
so that the copies of one conversation are split; then a row holds thousands of ids.

Rows come in order of turn, those without one first, then by the hash of role and text; repeated rows are turns
of their own. Null role or text is empty. Very long texts count by their hash and size. Rows without conv_id belong to no
conversation and are left out. Extra columns are ignored, whatever their names. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrisk.llm.common import partitions, stored

CONTAINER = 4096  # sequences that a container holds before it bursts
SHARED = 5  # conversations of one block take the first turns of the block's first
MOST_SHARED = 9  # of which there are fewer than this
CHUNK = 4096  # end ids in one row
KEY = 16
ROOT = b"\0" * KEY
NO_IDS = hashlib.sha256(b"").hexdigest()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# ---- sequences -----------------------------------------------------------------------------------------------
def turns_of(turns: DataFrame) -> DataFrame:
    """conv_id, turn, id and size of every turn; narrow."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.md5(both)).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )


_SEQUENCE = pa.schema([("conv_id", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("end", pa.binary())])
SEQUENCE_SCHEMA = "conv_id long, keys binary, sizes binary, end binary"


def sequence(conv: int, turns: list[tuple[bytes, int]]) -> tuple:
    """Chained hashes and text sizes of a conversation's prefixes, and the hash of the whole."""
    key, keys = ROOT, []
    for turn, _ in turns:
        key = hashlib.md5(key + turn).digest()  # noqa: S324
        keys.append(key)
    return conv, b"".join(keys), struct.pack(f"<{len(turns)}q", *[s for _, s in turns]), key


def sequences(turns: DataFrame, shared: int = 1, most_shared: int = 1) -> DataFrame:
    """One row per conversation. With ``shared`` > 1, conversation c takes the first h turns of conversation c - c % shared
    in place of its own first h; h is the CRC of its decimal id modulo ``most_shared``. A block is read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, head, conv, own = [], None, [], None, []

        def close() -> None:
            h = leads[0]
            if conv == block:
                head.extend(own[:most_shared])
                out.append(sequence(conv, own))
            else:
                out.append(sequence(conv, head[:h] + own[h:]))

        leads = [0]
        for batch in batches:
            for b, c, h, turn, size in zip(*[x.to_pylist() for x in batch.columns]):
                if conv is not None and (c != conv or b != block):
                    close()
                    own = []
                if b != block:
                    block, head = b, []
                conv = c
                leads[0] = h
                own.append((turn, size))
            if len(out) >= 2000:
                yield batch_of(out, _SEQUENCE)
                out = []
        if conv is not None:
            close()
        if out:
            yield batch_of(out, _SEQUENCE)

    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most_shared)).cast("int")
    rows = turns_of(turns).select((F.col("conv_id") - F.col("conv_id") % shared).alias("block"), "conv_id", h.alias("h"), "turn", "id", "size")
    in_order = rows.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "id")
    return in_order.select("block", "conv_id", "h", "id", "size").mapInArrow(run, SEQUENCE_SCHEMA)


# ---- hashes of the ids that end in a node --------------------------------------------------------------------
_CHUNKS = pa.schema([("end", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
_ENDS = pa.schema([("end", pa.binary()), ("ends_sha256", pa.string())])


def end_hashes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the ascending decimal ids, comma-joined, of every end. Sorted by range over (end, id), packed, then hashed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, end, first, ids = [], None, 0, []
        for batch in batches:
            for e, c in zip(*[x.to_pylist() for x in batch.columns]):
                if e != end or len(ids) >= chunk:
                    if ids:
                        out.append((end, first, ",".join(ids).encode()))
                    end, first, ids = e, c, []
                ids.append(str(c))
            if len(out) >= 1000:
                yield batch_of(out, _CHUNKS)
                out = []
        if ids:
            out.append((end, first, ",".join(ids).encode()))
        if out:
            yield batch_of(out, _CHUNKS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, end, sha = [], None, None
        for batch in batches:
            for e, _, ids in zip(*[x.to_pylist() for x in batch.columns]):
                if e != end:
                    if sha is not None:
                        out.append((end, sha.hexdigest()))
                    end, sha = e, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            if len(out) >= 5000:
                yield batch_of(out, _ENDS)
                out = []
        if sha is not None:
            out.append((end, sha.hexdigest()))
        if out:
            yield batch_of(out, _ENDS)

    n = partitions(rows.sparkSession)
    chunks = rows.select("end", "conv_id").repartitionByRange(n, "end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(pack, "end binary, first long, ids binary")
    return chunks.repartition("end").sortWithinPartitions("end", "first").mapInArrow(digest, "end binary, ends_sha256 string")


# ---- burst ---------------------------------------------------------------------------------------------------
def prefix(length) -> F.Column:
    """Key of the prefix of so many turns."""
    return F.when(length == 0, F.lit(ROOT)).otherwise(F.substring(F.col("keys"), (length - 1) * KEY + 1, F.lit(KEY)))


def burst(found: DataFrame, container: int) -> DataFrame:
    """Adds to every sequence the key and depth of the trie head whose container holds it."""
    placed = found.withColumn("depth", F.lit(0)).withColumn("head", F.lit(ROOT))
    step = 1
    while True:
        deep = F.col("length") > F.col("depth")
        full = placed.groupBy("head").agg(F.count(F.lit(1)).alias("_n"), F.count_if(deep).alias("_deep")).where((F.col("_n") > container) & (F.col("_deep") > 0)).select("head", F.lit(True).alias("_full"))
        full = stored(full, "trie-full")
        if full.isEmpty():
            return placed
        moved = F.when(F.col("_full"), F.least(F.col("length"), F.col("depth") + step)).otherwise(F.col("depth"))
        placed = placed.join(full, "head", "left").withColumn("depth", moved).drop("_full").withColumn("head", prefix(F.col("depth")))
        placed = stored(placed, "trie-round")
        step *= 2


# ---- sweep ---------------------------------------------------------------------------------------------------
_NODES = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()),
])
NODE_SCHEMA = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, keys binary, sizes binary"


class Open:
    """A node whose members are still coming."""

    __slots__ = ("key", "size", "conv", "n", "children", "leaves", "saved")

    def __init__(self, key: bytes, size: int):
        self.key, self.size, self.conv = key, size, None
        self.n = self.children = self.leaves = self.saved = 0

    def member(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def close(self) -> None:
        """Its own leaf and saving, once all members are known."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.size

    def child(self, node: Open) -> None:
        self.member(node.conv, node.n)
        self.children += 1
        self.leaves += node.leaves
        self.saved += node.saved


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes below each container's head, and with ``keys`` and ``sizes`` of its path the container's summary."""
    out: list[tuple] = []
    stack: list[Open] = []
    head = depth = last = path = None

    def pop(to: int) -> None:
        while len(stack) > to + 1:
            node = stack.pop()
            node.close()
            stack[-1].child(node)
            out.append((node.key, stack[-1].key, depth + len(stack), node.conv, node.n, node.children, node.leaves, node.saved, None, None))

    def summary() -> None:
        top = stack[0]  # what lies below the head; the head's own leaf and saving need its other containers
        out.append((head, None, depth, top.conv, top.n, top.children, top.leaves, top.saved, *path))

    for batch in batches:
        for h, d, keys, sizes, conv, n in zip(*[x.to_pylist() for x in batch.columns]):
            if h != head or d != depth:
                if stack:
                    pop(0)
                    summary()
                head, depth, stack[:], last = h, d, [Open(h, 0)], keys
                path = keys[: KEY * d], sizes[: 8 * d]
                same = 0
            else:
                same, most = 0, min(len(keys), len(last)) // KEY - d
                lo, hi = 0, most  # equal prefixes have equal keys: search the last equal one
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    at = (d + mid - 1) * KEY
                    lo, hi = (mid, hi) if keys[at : at + KEY] == last[at : at + KEY] else (lo, mid - 1)
                same, last = lo, keys
            pop(same)
            for i in range(d + same, len(keys) // KEY):
                stack.append(Open(keys[KEY * i : KEY * i + KEY], struct.unpack_from("<q", sizes, 8 * i)[0]))
            stack[-1].member(conv, n)
        if len(out) >= 5000:
            yield batch_of(out, _NODES)
            out.clear()
    if stack:
        pop(0)
        summary()
    if out:
        yield batch_of(out, _NODES)


# ---- heads ---------------------------------------------------------------------------------------------------
_PATH = pa.schema([("head", pa.binary()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64())])
PATH_SCHEMA = "head binary, key binary, parent binary, depth long, size long, conv_id long, n long, leaves long, saved long, children long"


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary as one row for each node from the root to the container's head."""
    for batch in batches:
        out = []
        for head, depth, conv, n, children, leaves, saved, keys, sizes in zip(*[x.to_pylist() for x in batch.columns]):
            above = ROOT
            for i in range(depth + 1):
                key = keys[KEY * (i - 1) : KEY * i] if i else ROOT
                size = struct.unpack_from("<q", sizes, 8 * (i - 1))[0] if i else 0
                out.append((head, key, above if i else None, i, size, conv, n, leaves, saved, children if i == depth else 0))
                above = key
                if len(out) >= 5000:
                    yield batch_of(out, _PATH)
                    out = []
        if out:
            yield batch_of(out, _PATH)


def head_nodes(summaries: DataFrame) -> DataFrame:
    """Nodes at and above the containers' heads, from the containers' summaries.

    A node's own leaf and saving are credited to one container under it and from there to all its ancestors, which
    are on that container's path.
    """
    rows = stored(summaries.select("key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "keys", "sizes").mapInArrow(paths, PATH_SCHEMA), "trie-paths")
    own = rows.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        F.sum("children").alias("below"), F.min("head").alias("head"),
    )
    heads_below = own.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("heads"))
    own = own.join(heads_below, "key", "left").withColumn("n_children", F.col("below") + F.coalesce("heads", F.lit(0)))
    own = stored(own.select("key", "parent", "depth", "conv_id", "n_convs", "n_children", "head", ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("own_leaf")), "trie-heads")
    credit = rows.join(own.select("key", "head", "own_saved", "own_leaf"), ["key", "head"], "left")
    down = Window.partitionBy("head").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = credit.select(
        "key", (F.col("leaves") + F.sum(F.coalesce("own_leaf", F.lit(0))).over(down)).alias("leaves"), (F.col("saved") + F.sum(F.coalesce("own_saved", F.lit(0))).over(down)).alias("saved")
    ).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return own.select("key", "parent", "depth", "conv_id", "n_convs", "n_children").join(summed, "key")


def trie(turns: DataFrame, shared: int = 1, most_shared: int = 1, container: int = CONTAINER) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes), ends_sha256."""
    rows = stored(sequences(turns, shared, most_shared), "trie-sequences")
    first = rows.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    # The first of a group of copies stands for all: its sequence is found by id, so that no sequence is shuffled twice.
    kept = rows.join(first.select("conv_id", "n"), "conv_id").select("conv_id", "n", "keys", "sizes", (F.octet_length("keys") / KEY).cast("int").alias("length"))
    placed = burst(stored(kept, "trie-distinct"), container)
    in_order = placed.repartition("head").sortWithinPartitions("head", "depth", "keys").select("head", F.col("depth").cast("long").alias("depth"), "keys", "sizes", "conv_id", "n")
    swept = stored(in_order.mapInArrow(sweep, NODE_SCHEMA), "trie-swept")
    columns = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    heads = head_nodes(swept.where(F.col("parent").isNull()))
    nodes = stored(swept.where(F.col("parent").isNotNull()).select(*columns).unionByName(heads.select(*columns)), "trie-nodes")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").join(end_hashes(rows).withColumnRenamed("end", "key"), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
