"""Substring and suffix-array dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from docrisk.llm import fm_dedup, suffix_dedup


def covered(texts, n):
    """Per row the words that lie in a window of n words occurring at two places."""
    words = [(t or "").encode().split() for _, t in texts]
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        flags = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                flags[i : i + n] = [True] * n
        out.append(flags)
    return words, out


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 300))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 34, 35, 36, 49, 50, 51, 70, 200)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += [p, " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append((i, " ".join(parts)))
    base = texts[7][1].split()
    near = [(100 + i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(0, len(base), 9)]
    same = [(200 + i, texts[9][1]) for i in range(5)]
    loop = [(300, "la " * 100), (301, "x y z " * 40), (302, "one\ttwo\n" * 3)]
    odd = [(400, None), (401, ""), (402, " \n\t"), (403, "short text"), (403, "short text"), (404, texts[9][1].replace(" ", "\n")), (405, "é ü " * 80)]
    return texts + near + same + loop + odd


@pytest.mark.parametrize("shard_words", [400_000, 700, 60])
def test_fm_dedup_is_exact(spark, docs_of, shard_words):
    """Also with many shards, and with anchors so hot that they are split by whole windows."""
    texts = corpus()
    words, flags = covered(texts, 35)
    want = sorted(
        (d, len(w), sum(f), hashlib.sha256(b" ".join(x for x, g in zip(w, f) if not g)).hexdigest()) for (d, _), w, f in zip(texts, words, flags)
    )
    got = sorted(map(tuple, fm_dedup.dedup(docs_of(texts), shard_words=shard_words).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == want


def test_hot_windows_fill_no_shard(spark, docs_of, monkeypatch):
    """One passage in many different documents: no shard gets more than its planned words."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = words(40)
    texts = [(i, " ".join(words(36) + passage + words(36))) for i in range(60)]
    sent, plain = [], fm_dedup.routed
    monkeypatch.setattr(fm_dedup, "routed", lambda *a: sent.append(plain(*a)) or sent[-1])
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in fm_dedup.dedup(docs_of(texts), shard_words=500).collect()}
    assert got == {i: [(36, 76)] for i, _ in texts}
    load = collections.Counter()
    for r in sent[0].select("shard", "blob").collect():
        load[r["shard"]] += len(bytes(r["blob"]).split())
    assert max(load.values(), default=0) <= 1000


def test_suffix_spans_are_sound_and_nearly_complete(spark, docs_of):
    texts = corpus(8)
    words, flags = covered(texts, 50)
    want = {d: f for (d, _), f in zip(texts, flags)}
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(docs_of(texts)).collect()}
    missing = total = 0
    for d, f in want.items():
        mine = [False] * len(f)
        for a, b in got[d]["spans"] if d in got else ():
            assert 0 <= a and b <= len(f) and b - a >= 50
            mine[a:b] = [True] * (b - a)
        assert not any(m and not t for m, t in zip(mine, f))
        missing += sum(t and not m for m, t in zip(mine, f))
        total += sum(f)
        assert any(f) == (d in got)
    assert missing <= 0.02 * total


def check_suffix_spans(got, texts):
    _, flags = covered(texts, 50)
    spans = {r["doc_id"]: r["spans"] for r in got}
    for (d, _), f in zip(texts, flags):
        mine = [False] * len(f)
        for a, b in spans.get(d, ()):
            mine[a:b] = [True] * (b - a)
        assert mine == f


@pytest.mark.parametrize("most", [2000, 3])
def test_suffix_spans_of_rows_that_are_not_neighbours(spark, docs_of, most):
    """Parts of passages of 50 to 74 words stand in other documents, between whole ones in the suffix order."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for n in (50, 50, 50, 54, 60, 74):
        passage = words(n)
        for i in range(3):
            texts.append(words(40) + passage + words(40))
        for cut in (5, 10, 15, 20, 24):
            for _ in range(4):
                texts.append(words(40) + passage[cut:] + words(40))
    texts = [(i, " ".join(t) + (" \x01 a\x02" if i % 5 == 0 else "")) for i, t in enumerate(texts)]
    check_suffix_spans(suffix_dedup.repeats(docs_of(texts), **({} if most == 2000 else {"most": most})).collect(), texts)


def test_neighbours_across_partitions(spark, docs_of):
    """One passage fills all partitions; every document reports it."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(i, f"{' '.join(f'a{i}x{j}' for j in range(30))} {passage} {' '.join(f'b{i}x{j}' for j in range(30))}") for i in range(80)]
    rows = suffix_dedup.repeats(docs_of(texts)).collect()
    assert len(rows) == 80 and all([tuple(s) for s in r["spans"]] == [(30, 90)] for r in rows)


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "a")]).limit(0)
    assert fm_dedup.dedup(none).count() == 0
    assert suffix_dedup.repeats(none).count() == 0


def test_index_against_counting():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(60)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
    index = fm_dedup.FMIndex(text)
    flat = ["".join(map(str, p)) for p in parts]
    ends, want = [], []
    at = 0
    for p, s in zip(parts, flat):
        for e in range(1, len(p) + 1):
            ends.append(at + e)
            n = 0
            while n < min(e, 10):
                piece = s[e - n - 1 : e]
                times = sum(sum(t.startswith(piece, i) for i in range(len(t))) for t in flat)
                if times < 2:
                    break
                n += 1
            want.append(n)
        at += len(p) + 1
    assert index.match_lengths(text, np.array(ends), 10).tolist() == want
