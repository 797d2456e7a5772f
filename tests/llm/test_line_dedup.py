import collections
import random
import re

from pyspark.sql import functions as F

from docrisk.llm import line_dedup as ld

KIND = re.compile(r"[\d@]|://", re.ASCII)


def brute(texts, depth=3, least=ld.MIN_SOURCES, likeness=ld.LIKENESS):
    """The same decisions with plain Python, on sets of texts."""
    lines = {t or "": [x.strip(" ") for x in (t or "").split("\n")] for _, t in texts}
    leaf_of = lambda x: (x.count(" ") + 1, tuple("<*>" if KIND.search(w) else w for w in x.split(" ")[:depth]))
    reach, holds = collections.defaultdict(set), collections.defaultdict(set)
    for t, rows in lines.items():
        for x in filter(None, rows):
            reach[leaf_of(x)].add(t)
            holds[x].add(t)
    votes = collections.Counter()
    for x, ts in holds.items():
        for p, w in enumerate(x.split(" ")):
            votes[leaf_of(x), p, w] += len(ts)
    template = {}
    for x in holds:
        f, words = leaf_of(x), x.split(" ")
        if len(reach[f]) < least:
            continue
        body = [(p, w) for p, w in enumerate(words) if p >= depth and not KIND.search(w)]
        fixed = [(p, w) for p, w in body if votes[f, p, w] >= least]
        lead = sum(not KIND.search(w) for w in words[:depth])
        if len(fixed) * 100 >= len(body) * likeness and 2 * (lead + len(fixed)) >= len(words):
            template[x] = f, tuple(fixed)
    found = set()
    for this in set(template.values()):
        held = {t for x, v in template.items() if v == this for t in holds[x]}
        sources = 0
        for t in held:
            sized = [(len(r), x) for r, x in zip(t.split("\n"), lines[t])]
            rest = sum(n for n, x in sized if template.get(x) != this)
            bits = lambda f: len(reach[f]).bit_length() if len(reach[f]) >= least else 0
            body = sum(n for n, x in sized if not x or bits(leaf_of(x)) <= len(held).bit_length() - 2)
            sources += body > 0 and 2 * body >= rest
        if len(held) >= least and sources >= least:
            found.add(this)
    keeper = {}
    for d, t in texts:
        for x in lines[t or ""]:
            v = template.get(x)
            if v in found and d is not None:
                keeper[v] = min(d, keeper.get(v, d))
    out = []
    for d, t in texts:
        rows = (t or "").split("\n")
        gone = {p for p, x in enumerate(lines[t or ""]) if template.get(x) in found and keeper.get(template[x]) != d}
        out.append((d, "\n".join(x for p, x in enumerate(rows) if p not in gone) if gone else t, len(gone)))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for i in range(40):
        lines = [line(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(0, "Home  About us Contact")
        if i % 3 == 0:
            lines.append(f"Posted on {i} May 20{i} by user{i}@mail.example in news")
        if i % 4 == 0:
            lines.insert(1, f"Terms of use and {word()} apply here")
        lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  ", "unique " + line(3)]))
        texts.append((i, "\n".join(lines)))
    texts += [(100 + i, texts[5][1]) for i in range(20)]  # copies are one source
    texts += [(200, None), (201, ""), (202, "\n\n"), (203, "Home About us Contact"), (203, "Home About us Contact"), (204, "x" * 200_000 + "\nHome About us Contact"), (None, "Home About us Contact\nmy own words here")]
    return texts


def test_against_brute_force(spark, docs_of):
    texts = corpus()
    out = ld.drop_lines(docs_of(texts))
    assert "label" in out.columns
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()), key=str)
    assert got == sorted(brute(texts), key=str)
    lost = {r[0]: r[2] for r in got}
    assert lost[1] == 0 and lost[3] >= 1  # the first document keeps its line
    assert sum(lost[100 + i] for i in range(20)) <= 20 * 3
    assert sum(n for *_, n in got) > 30


def test_copies_alone_lose_nothing(spark, docs_of):
    text = "first line of many words here\nsecond line also has words\nthe third"
    assert all(r["n_dropped"] == 0 and r["text"] == text for r in ld.drop_lines(docs_of([(i, text) for i in range(50)])).collect())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def dropped(docs, **more):
    return {r["doc_id"]: r["n_dropped"] for r in ld.drop_lines(docs, **more).collect()}


def test_footer_that_is_the_longest_line(spark, docs_of):
    rng = random.Random(1)
    footer, header = words(rng, 60), "Home News About Contact"
    got = dropped(docs_of([(i, "\n".join([header, *(words(rng, 12) for _ in range(9)), footer])) for i in range(12)]))
    assert got == {0: 0, **{i: 2 for i in range(1, 12)}}


def test_unique_lines_that_begin_alike_stay(spark, docs_of):
    rng = random.Random(2)
    texts = [(i, "\n".join([words(rng, 15), "It was said that " + words(rng, 8), words(rng, 20)])) for i in range(40)]
    assert set(dropped(docs_of(texts)).values()) == {0}


def test_a_leaf_holds_several_templates(spark, docs_of):
    rng = random.Random(3)
    footers = ["All rights reserved by the owner of this page", "All rights reserved for every reader in the world", "All rights reserved as {} wished at that time"]
    texts = [(i, words(rng, 40) + "\n" + footers[i % 3].format(words(rng, 1))) for i in range(30)]
    assert dropped(docs_of(texts)) == {i: int(i > 2) for i in range(30)}


def test_near_copies_lose_nothing(spark, docs_of):
    rng = random.Random(4)
    base, texts = [words(rng, 20).split(" ") for _ in range(8)], []
    for i in range(60):
        lines = [list(x) for x in base]
        for _ in range(3):
            line = rng.choice(lines)
            line[rng.randrange(len(line))] = words(rng, 1)
        texts.append((i, "\n".join(map(" ".join, lines))))
    assert set(dropped(docs_of(texts)).values()) == {0}


def test_columns_that_clash(spark, docs_of):
    rng = random.Random(5)
    docs = docs_of([(i, words(rng, 30) + "\nHome News About Contact") for i in range(6)])
    names = ["k1", "k2", "d1", "h2", "gone", "doc", "kept", "leaf", "lh", "pos", "keeper", "lines", "total", "size", "bits", "_gone", "n_lines", "template"]
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    out = ld.drop_lines(docs)
    assert sorted(out.columns) == sorted(set(docs.columns) | {"n_dropped"})
    rows = out.orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"]) for r in rows] == [(2, 0)] + [(2, 1)] * 5
    assert all(r[n] == "mine" for r in rows for n in names if n != "n_lines")


def test_empty_table_and_plan(spark, docs_of):
    out = ld.drop_lines(docs_of([(1, "a")]).limit(0))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
