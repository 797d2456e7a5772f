import random
import re

import pytest

from docrisk.llm import decontaminate as dc


def sets(t, lengths):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + n]) for n in lengths for i in range(len(w) - n + 1)}


def brute(texts, items, threshold=0.8):
    out = set()
    for item, t in items:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        if not n:
            continue
        mine = sets(t, [n])
        for d, text in texts:
            if len(mine & sets(text, [n])) >= threshold * len(mine):
                out.add((d, item))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((6, 9, 35, 60, 300))))) for i in range(30)]
    items += [(90, "only three words"), (91, "one"), (92, None), (93, ""), (94, "..."), (95, items[0][1])]
    texts = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 400))]
        if i % 3 == 0:
            t = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice((0, 0, 1, 2, len(t) // 40, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            parts = parts + [x.upper() if i % 2 else x + "," for x in t] + [word() for _ in range(50)]
        texts.append((i, " ".join(parts)))
    texts.append((200, " ".join(word() for _ in range(30_000)) + " " + items[2][1]))
    texts += [(201, None), (202, ""), (203, "Only three, WORDS here"), (204, "one"), (203, "Only three, WORDS here"), (203, "other text")]
    return texts, items


@pytest.mark.parametrize("k", [32, 12])
def test_against_brute_force(spark, docs_of, k):
    texts, items = corpus()
    item_rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = dc.search(docs_of(texts), item_rows, k=k).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(texts, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert all(0.8 <= r["containment"] <= 1 for r in got)
    kept = dc.clean(docs_of(texts), item_rows)
    bad = {d for d, _ in brute(texts, items)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in texts if d not in bad)
    assert "label" in kept.columns


def test_texts_without_id_go_one_by_one(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    texts = [(None, "x a b c d e f g"), (None, "quite another text"), (None, None), (5, "x a b c d e f g"), (6, "clean")]
    out = dc.clean(docs_of(texts), items)
    assert out.columns == docs_of(texts).columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([texts[1], texts[2], texts[4]], key=str)


def test_small_bit_table_loses_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dc, "MAX_BITS", 1 << 12)
    texts, items = corpus()
    item_rows = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.search(docs_of(texts), item_rows).collect()} == brute(texts, items)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = docs_of([(1, "x a b c d e f g")])
    assert dc.search(docs.limit(0), items).count() == 0
    assert dc.search(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items.limit(0)).count() == 1
    assert dc.search(docs, items).count() == 1


def test_clean_with_clashing_columns(spark, make):
    from pyspark.sql import functions as F

    names = ["nameless", "id_or_k1", "k2_or_0", "_n", "k1", "item_id", "hash"]
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    df = make([(1, "x one two three four five six seven y", "en", "s"), (2, "nothing of that kind is here", "en", "s"), (None, "no id at all", "en", "s")], extra=False).withColumns({n: F.lit(n) for n in names})
    got = sorted((r.doc_id or 0, *(r[n] for n in names)) for r in dc.clean(df, items).collect())
    assert got == [(0, *names), (2, *names)]
