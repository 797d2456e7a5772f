import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docrisk.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(row):
    role, text = (row[2] or "").encode(), (row[3] or "").encode()
    return (row[1] is not None, row[1] or 0, hashlib.md5(b"%d:" % len(role) + role + text).digest())


def rebuilt(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(n * 2), n):
        if rnd.random() < 0.2:
            turns = [("user", f"shared {i}") for i in range(12)]  # copies of one conversation
        else:
            turns = [(rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", "", "ccc"])) for _ in range(rnd.randrange(0, 7))] or [("user", "only")]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("container", [1, 2, 5, 4096])
def test_against_brute_force(spark, container):
    rows = random_rows(container)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in prefix_trie.trie(df, 5, 9, container).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute(rebuilt(rows))


def test_long_shared_passage_bursts(spark):
    rows = [(c, i, "user", f"same {i}" if i < 40 else f"own {c} {i}") for c in range(12) for i in range(38 + c % 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    seqs = defaultdict(list)
    for c, _, role, text in rows:
        seqs[c].append((role, text))
    got = [tuple(r) for r in prefix_trie.trie(df, container=2).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute(seqs)


def test_nulls_ties_repeats_negative_ids_and_clashing_columns(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([-7, -5, 0, 3, 5, 9, None]), rnd.choice([None, 0, 1, 1, 2]), rnd.choice([None, "user"]), rnd.choice([None, "", "x", "y" * 50_000])) for _ in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "size", "keys", "end", "n", "head", "depth", "block", "h"):
        df = df.withColumn(name, F.lit(1))
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    got = [tuple(r) for r in prefix_trie.trie(df, container=2).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute(own)
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        seqs[c] = own.get(base, [])[:h] + turns[h:]
    got = [tuple(r) for r in prefix_trie.trie(df, 5, 9).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute(seqs)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA), 5, 9).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA), 5, 9).collect() == []


def test_end_ids_over_many_rows(spark):
    rows = [(c, 0, "user", "a" if c % 3 else "b") for c in range(50)]
    ends = prefix_trie.end_hashes(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA)), chunk=3).collect()
    want = [",".join(str(c) for c in range(50) if bool(c % 3) == odd) for odd in (False, True)]
    assert sorted(r.ends_sha256 for r in ends) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)
