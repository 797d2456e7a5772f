import hashlib
import re

from pyspark.sql import functions as F

from docrisk.llm import fingerprints as fp


def edited(texts):
    order = sorted(texts, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nx = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out[i] = t[: len(t) - m] + nx[:m]
    return out


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_against_brute_force(spark, docs_of):
    texts = [(i * 7, " ".join(f"w{(i * j * j) % 997}" for j in range(n))) for i, n in enumerate((1, 3, 4, 5, 6, 40, 300, 5000, 301))]
    texts += [(100, None), (101, ""), (102, "\U0001f600é x"), (103, texts[6][1])]
    want = edited(texts)
    rows = {r["doc_id"]: r for r in fp.fingerprint(spark, docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    plain = {i: t or "" for i, t in texts}
    for i, t in texts:
        r = rows[i]
        assert r["n_chars"] == len(t or "")
        assert r["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        a, b = shingles(plain[i]), shingles(want[i])
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - true) <= (0.0 if len(a | b) <= fp.K else 0.15)
        assert abs(r["n_shingles"] - len(a)) <= 0.3 * len(a)
    assert rows[42]["fingerprint"] == rows[103]["fingerprint"]
    assert rows[103]["near_next"] < 1


def test_repeated_ids_one_row_and_no_rows(spark, docs_of):
    assert fp.fingerprint(spark, docs_of([(1, "a b"), (1, "a b"), (1, "c")])).count() == 3
    one = fp.fingerprint(spark, docs_of([(5, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.fingerprint(spark, docs_of([(5, "a")]).limit(0)).count() == 0


def test_ranges_do_not_change_the_order(spark, docs_of):
    texts = [(i * i, f"text number {i} of many") for i in range(60)]
    for parts in (1, 2, 17):
        got = {r["doc_id"]: r["nx"] for r in fp.with_next(docs_of(texts), parts).where("not ghost").collect()}
        assert all(got[i * i] == texts[i - 1][1] for i in range(60))


def test_sketches_merge(spark, docs_of):
    texts = [(i, " ".join(f"v{(i * 31 + j) % 400}" for j in range(200))) for i in range(6)]
    df = docs_of(texts).select("doc_id", F.lit(1).alias("g"), fp.sketch(F.col("text")).alias("s"))
    every = sorted({h for r in df.collect() for h in r["s"]})
    assert df.agg(fp.merge_all("s").alias("s")).first()["s"] == every[: fp.K]
    assert fp.merge_groups(df, "g", "s").first()["s"] == every[: fp.K]


def test_plan_has_no_python(spark, docs_of):
    plan = fp.fingerprint(spark, docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
