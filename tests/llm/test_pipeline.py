"""The stages one after another on the small tables, each against what it was given."""

import collections

import corpus_pipeline
import pytest

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_packing import check as packed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    out = corpus_pipeline.stored(stages["quality"](spark, docs, SF), "t")
    assert out.columns == columns
    quality = {r["doc_id"]: int(r["quality"] and not r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in pairs(out)}
    assert sum(d in kept for d, q in quality.items() if q == 1) >= 0.97 * sum(quality.values())
    assert sum(d in kept for d, q in quality.items() if q == 0) < 0.3 * (len(quality) - sum(quality.values()))

    before, out = pairs(out), corpus_pipeline.stored(stages["line_dedup"](spark, out, SF), "t")
    assert out.columns == columns and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    want = [(d, t) for d, t, n in lines(before) if not n or t.strip(" ")]
    assert sorted(pairs(out)) == sorted(want)

    before, out = pairs(out), corpus_pipeline.stored(stages["near_duplicates"](spark, out, SF), "t")
    first = {}
    for d, c, _ in classes(before):
        first[c] = min(d, first.get(c, d))
    assert out.columns == columns and sorted(pairs(out)) == sorted(x for x in before if x[0] in set(first.values()))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, out = pairs(out), corpus_pipeline.stored(stages["decontamination"](spark, out, SF), "t")
    bad = {d for d, _ in leaks(before, items)}
    assert bad and out.columns == columns and sorted(pairs(out)) == sorted(x for x in before if x[0] not in bad)

    before, out = pairs(out), stages["packing"](spark, out, SF)
    packed(out.collect(), before, 4096)


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    total = collections.Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert rows and max(total.values()) <= 4096


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_empty_input(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count() == 0
