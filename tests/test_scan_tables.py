"""The scan as one fold over fact tables against the scan on facts rows, and what only the fold's tables can show."""

from pyspark.sql import functions as F

from docrisk.catalog.scan_queries import all_tables, lines_of
from docrisk.catalog.views import Inputs
from docrisk.operators import binary, office, pdfspans, rollup
from docrisk.plans import scan as plan

SHOWN = ("file_id", "detected_type", "av_status", "risk_score", "risk_level", "verdict")


def rows(df):
    evidence = F.array_sort(F.transform("evidence", lambda e: F.concat_ws("/", e["rule_id"], e["severity"], e["score"].cast("string"), e["occurrences"].cast("string"))))
    return sorted(tuple(r) for r in df.select(*SHOWN, F.array_join(evidence, ",").alias("e")).collect())


def test_one_fold_equals_facts_rows(spark, small):
    x = Inputs(spark, small)
    tables = all_tables(x)
    facts = {"pdf": pdfspans.facts(*tables.pdf), "exe": binary.facts(*tables.exe), "docx": office.facts(*tables.docx), "json": tables.json}
    got = rows(plan.scan_tables(x.fx_files, x.fx_av, tables))
    assert got == rows(plan.scan(x.fx_files, x.fx_av, facts)) and len(got) == x.fx_files.count()


def test_part_warnings_reach_the_scan(spark):
    files = spark.createDataFrame([(i, 1, f"h{i}", 10, "a.docx", "504B0304") for i in (1, 2, 3)], "file_id long, user_id long, sha256 string, size long, filename string, head_hex string")
    av = spark.createDataFrame([(f"h{i}", "clean") for i in (1, 2, 3)], "sha256 string, status string")
    names = ("[Content_Types].xml", "word/document.xml")
    entries = spark.createDataFrame([(d, s, n, 100, 50, 0) for d in (1, 2) for s, n in enumerate(names)], "doc_id long, seq long, name string, size long, compressed_size long, flag_bits int")
    runs = spark.createDataFrame([(d, names[1], 1, "Some plain words.", False, "000000", 24, False) for d in (1, 2)], "doc_id long, part string, seq long, text string, vanish boolean, color string, half_points int, deleted boolean")
    rels = spark.createDataFrame([], "doc_id long, seq long, target_mode string, target string, rel_type string")
    parts = spark.createDataFrame([(1, 1, "word/document.xml", 9, "<a><b></a>"), (2, 1, "word/document.xml", 9, "<a/>"), (9, 1, "x.xml", 9, "<a>")], "doc_id long, seq long, name string, size long, xml string")
    found = {r.file_id: r for r in plan.scan_tables(files, av, plan.Tables(docx=(entries, runs, rels, parts))).collect()}
    assert sorted(found) == [1, 2, 3]
    assert found[1].docx_facts.warnings == ["malformed-or-unreadable-xml-part"] and "OD-2" in [e.rule_id for e in found[1].evidence]
    assert found[2].docx_facts.warnings == [] and found[2].evidence == [] and found[2].verdict == "allow"
    assert found[3].docx_facts is None and found[3].verdict == "review"  # a routed file without facts


def test_fold_merges_sources_of_one_key(spark):
    a = spark.createDataFrame([(1, 5), (1, 7), (2, None)], "k long, v long")
    b = spark.createDataFrame([(1, "x", 3), (1, "y", 1), (3, "z", None)], "id long, name string, at long")
    sources = [
        rollup.Source(a, "k", "a_", {"n": rollup.rows(), "sum": rollup.total(F.col("v")), "big": rollup.any_(F.col("v") > 6)}),
        rollup.Source(b, "id", "b_", {"first": rollup.first_by(F.col("name"), F.col("at")), "last": rollup.last_by(F.col("name"), F.col("at")), "odd": rollup.count_if(F.col("at") % 2 == 1)}),
    ]
    got = sorted(tuple(r) for r in rollup.folded(sources, "key").collect())
    assert got == [(1, 2, 12, True, "y", "x", 2), (2, 1, None, None, None, None, 0), (3, 0, None, None, None, None, 0)]


def test_only_lines_of_files_are_dealt_out(spark, small):
    x = Inputs(spark, small)
    kept = lines_of(x, x.fx_files.select("file_id"))
    files = {r.file_id for r in x.fx_files.select("file_id").collect()}
    want = sorted(r.l_orderkey for r in x.lineitem.select("l_orderkey").collect() if r.l_orderkey in files)
    assert sorted(r.l_orderkey for r in kept.collect()) == want and 0 < len(want) < x.lineitem.count()
    read = all_tables(x).pdf[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "REPARTITION" in read.upper() and "l_shipdate" not in read
    assert all("/lineitem.parquet" not in f for t in all_tables(x).pdf for f in t.inputFiles())
