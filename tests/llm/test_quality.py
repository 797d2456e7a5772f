import random

import numpy as np
import pytest

from docrisk.llm import quality


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, labels = [], {}
    for i in range(n):
        good = rng.random() < 0.8
        words = [word() for _ in range(rng.randint(5, 80))]
        text = " ".join(words) if good else rng.choice([" ".join(w + "###" for w in words), " ".join([words[0]] * 40), " | ".join(words)])
        rows.append((i, text, "en", "site" if good else rng.choice(["site", "spam"])))
        labels[i] = int(good)
    return rows, labels


ABUSE = r"(?i)\b(trash|pathetic|idiot|disgusting|worthless|clown|loser|scum|stupid|moron)\b"


def test_held_out_accuracy_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    flagged = docs.select("doc_id", docs["text"].rlike(ABUSE).alias("abuse"))
    scored = quality.score(docs, quality.train(docs, train)).join(labels.where("doc_id % 2 = 1"), "doc_id").join(flagged, "doc_id").collect()
    good = [r for r in scored if r["quality"] == 1 and not r["abuse"]]  # toxic labels on other texts are noise
    assert sum(r["keep"] for r in good) >= 0.98 * len(good)
    assert sum(r["keep"] == (r["quality"] == 1 and not r["abuse"]) for r in scored) >= 0.98 * len(scored)
    abuse = [r for r in scored if r["abuse"]]
    assert len(abuse) > 100 and sum(not r["keep"] for r in abuse) >= 0.95 * len(abuse)


def test_distributed_sums_equal_local_ones(spark, make):
    """The same training on a collected table, by another split of its rows, gives the same weights."""
    rng = np.random.default_rng(5)
    text = [rng.normal(size=(n, quality.BASE_DIMS)).astype(np.float32) for n in (120, 3000)]
    meta = [np.hstack([rng.integers(0, 60, (n, 2)), rng.random((n, 1)), np.zeros((n, 1))]).astype(np.float32) for n in (120, 3000)]
    y = (text[0][:, 0] + 0.3 * rng.normal(size=120) > -0.5).astype(float)
    raw = [text[0], quality.spread(meta[0])]
    scales = [quality.Scale.of(x) for x in raw]
    labelled = tuple(s(x) for s, x in zip(scales, raw))
    rest = tuple(s(x) for s, x in zip(scales, (text[1], quality.spread(meta[1]))))
    masks = [np.ones(120, bool), np.arange(120) % 3 != 0]
    local = quality.co_train(labelled, y, masks, quality.Pool(rest))
    rows = spark.createDataFrame([(bytes(v),) for v in quality.packed(text[1], meta[1])], "view binary")
    for n in (1, 7):
        spread = quality.co_train(labelled, y, masks, quality.StoredPool(rows.repartition(n), scales))
        for a, b in zip(local, spread):
            assert all(np.array_equal(m.weights, o.weights) for m, o in zip(a.models, b.models))


def test_steps_reach_the_optimum():
    """Newton steps with the round's curvature end where the gradient of labels and pseudo-labels vanishes."""
    rng = np.random.default_rng(9)
    x = [rng.normal(size=(2400, 12)) for _ in range(2)]
    x[1][:, 0] = x[0][:, 0]
    scales = [quality.Scale.of(part[:400]) for part in x]
    z = [s(part) for s, part in zip(scales, x)]
    y = (x[0][:400, 0] > 0).astype(float)
    few = quality.co_train(tuple(p[:400] for p in z), y, [np.ones(400, bool)], quality.Pool(tuple(p[400:] for p in z)), rounds=1)
    many = quality.co_train(tuple(p[:400] for p in z), y, [np.ones(400, bool)], quality.Pool(tuple(p[400:] for p in z)), rounds=1, steps=40)
    alone = quality.co_train(tuple(p[:400] for p in z), y, [np.ones(400, bool)], quality.Pool(tuple(p[400:] for p in z)), rounds=0)
    for a, b, c in zip(few[0].models, many[0].models, alone[0].models):
        assert abs(a.weights - b.weights).max() < 0.05 < abs(b.weights - c.weights).max()


def test_rare_kinds_outside_the_labels_count(spark, make):
    """Unlabelled rows are not sampled: every one is a row of the pool."""
    rows, labels = corpus()
    known = spark.createDataFrame([(i, y) for i, y in labels.items() if i < 100], "doc_id long, quality int")
    seen = []

    class Counting(quality.StoredPool):
        def total(self, of, size):
            seen.append(self.rows.count())
            return super().total(of, size)

    plain, quality.StoredPool = quality.StoredPool, Counting
    try:
        quality.train(make(rows + [(None, "no id", "en", "x")] * 3), known)
    finally:
        quality.StoredPool = plain
    assert set(seen) == {303}


def test_rejects_and_odd_rows(spark, make):
    rows, labels = corpus()
    odd = [(1000, None, None, None), (1001, "", "en", "site"), (None, rows[0][1], "en", "site"), (0, rows[0][1], "en", "site"), (1002, "word " * 50_000, "en", "site")]
    docs = make(rows + odd)
    known = spark.createDataFrame([(i, y if i % 17 else None, "z") for i, y in labels.items() if i % 2], "doc_id long, quality int, text string")
    scored = quality.classify(docs, known).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in scored)
    right = [r["keep"] == bool(labels[r["doc_id"]]) for r in scored if r["doc_id"] in labels and r["doc_id"] % 2 == 0]
    assert np.mean(right) > 0.95
    twice = [r["score"] for r in scored if r["doc_id"] == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in scored)


def test_without_labels_everything_stays(spark, make):
    docs = make([(1, "a", "en", "s"), (2, None, None, None)])
    for rows in ([], [(1, 1)], [(1, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert [(r["score"], r["keep"]) for r in quality.classify(docs, labels).collect()] == [(0.5, True)] * 2
        assert quality.keep_good(docs, labels).count() == 2
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).count() == 0


def test_views_exchange_labels():
    """With few labels the rounds help: what one view is sure of teaches the other."""
    rng = np.random.default_rng(1)

    def sample(n):
        y = (rng.random(n) < 0.5).astype(float)
        a = np.hstack([(2 * y - 1)[:, None] * 2.2 + rng.normal(size=(n, 1)), rng.normal(size=(n, 40))])
        b = np.hstack([(2 * y - 1)[:, None] * 2.2 + rng.normal(size=(n, 1)), rng.normal(size=(n, 40))])
        return (a, b), y

    parts, y = sample(40)
    scales = [quality.Scale.of(p) for p in parts]
    scaled = lambda pair: tuple(s(p) for s, p in zip(scales, pair))
    labelled, pool = scaled(parts), quality.Pool(scaled(sample(2000)[0]))
    test, truth = sample(2000)
    test = scaled(test)

    def accuracy(models):
        odds = sum(m.odds(t) for m, t in zip(models, test))
        return np.mean((odds > 0) == truth)

    alone = accuracy(quality.co_train(labelled, y, [np.ones(40, bool)], pool, rounds=0)[0].models)
    together = accuracy(quality.co_train(labelled, y, [np.ones(40, bool)], pool, rounds=3)[0].models)
    assert together >= alone and together > 0.95


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < quality.sigmoid(1.5 * x[:, 0] - 1)).astype(float)
    z = quality.Scale.of(x)(x)
    model = quality.fit(z, y)
    model.weights = model.weights * 5
    quality.calibrate(model, model.odds(z), y)
    p = quality.sigmoid(model.calibrated(z))
    assert p.mean() == pytest.approx(y.mean(), abs=0.02)
    top = p > 0.8
    assert y[top].mean() == pytest.approx(p[top].mean(), abs=0.05)
