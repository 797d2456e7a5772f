import collections
import random
import re

import numpy as np
import pytest

from docrisk.llm import ngram_join
from docrisk.llm.components import components


def brute(texts, threshold=0.8):
    sets = {}
    for d, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets[t or ""] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    keys = list(sets)
    links, parent = collections.Counter(), {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            inter = len(sets[a] & sets[b])
            if inter and inter >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    smallest = {}
    for d, t in texts:
        r = find(t or "")
        smallest[r] = min(smallest.get(r, d), d)
    return sorted((d, smallest[find(t or "")], links[t or ""]) for d, t in texts)


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 4000)}"
    texts = [(i, " ".join(word() for _ in range(rng.randint(1, 200)))) for i in range(40)]
    base = [word() for _ in range(120)]
    for i in range(60):  # a chain and a crowd around one text
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append((100 + i, " ".join(t)))
    texts += [(200 + i, texts[3][1]) for i in range(7)]
    texts += [(300, texts[3][1].upper()), (301, "a b"), (302, "A, b!"), (303, "a b"), (304, None), (305, ""), (306, "..."), (307, "a b c d e"), (301, "a b")]
    return texts


@pytest.mark.parametrize("block", [1000, 7])
def test_against_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    texts = corpus()
    got = sorted(map(tuple, ngram_join.join(docs_of(texts)).select("doc_id", "class_id", "n_links").collect()))
    assert got == brute(texts)


def test_one_per_class(spark, docs_of):
    texts = corpus()
    want = {}
    for d, c, _ in brute(texts):
        want[c] = d if c not in want else min(d, want[c])
    out = ngram_join.one_per_class(docs_of(texts))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "label"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want.values())


def test_null_ids_and_empty_table(spark, docs_of):
    out = ngram_join.one_per_class(docs_of([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s")]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"]) == [(3, "a b c d e f")]
    assert out.count() == 2
    assert ngram_join.join(docs_of([(1, "a")]).limit(0)).count() == 0


def test_texts_without_own_id_do_not_replace_each_other(spark, docs_of):
    texts = [(None, "one two three four five six"), (None, "q r s t u v"), (None, "q r s t u v"), (None, ""), (7, "red green blue white black"), (7, "cat dog cow hen fox")]
    out = ngram_join.one_per_class(docs_of(texts))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(set(texts), key=str)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.band_plan(0.8, 0.9998)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9998 and rows >= 5


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(90)]
    got = ngram_join.shared_counts(sets, dense_from=20)
    for i in range(0, 90, 7):
        for j in range(90):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 300 + i) for i in range(30)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 102)} == {100} and got[315] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_of_groups_by_their_leads(spark):
    import random

    from docrisk.llm.components import of_members

    rng = random.Random(2)
    buckets = [sorted(rng.sample(range(60), rng.randint(2, 5))) for _ in range(25)]
    pairs = [(n, b[0]) for b in buckets for n in b]
    got = {r.node: r.label for r in of_members(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    root = {n: n for n, _ in pairs}
    for _ in range(60):
        for n, lead in pairs:
            low = min(root[n], root[lead])
            root[n] = root[lead] = low
    assert got == root


def test_one_per_class_with_clashing_columns(spark, make):
    from pyspark.sql import functions as F

    names = ["keep_id", "keep_1", "keep_2", "text_1", "text_2", "k1", "k2", "node", "label", "_d", "class_id", "n_links"]
    df = make([(1, "a b c d e f g", "en", "s"), (2, "a b c d e f g", "en", "s"), (3, "other words here now then", "en", "s")], extra=False).withColumns({n: F.lit(n) for n in names})
    got = ngram_join.one_per_class(df).orderBy("doc_id").collect()
    assert [(r.doc_id, *(r[n] for n in names)) for r in got] == [(1, *names), (3, *names)]
