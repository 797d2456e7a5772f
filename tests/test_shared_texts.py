"""Work that depends on a text alone is done once per distinct text."""

from pyspark.sql import functions as F

from docrisk.functions.skew import per_value
from docrisk.operators import evidence, pdfspans

SPAN = "doc_id long, page int, seq long, text string, font_size double, x0 double, y0 double, x1 double, y1 double, color int, page_w double, page_h double"


def test_values_are_read_once_each(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def slow(text):
        seen.add(1)
        return -1 if text is None else len(text)

    rows = spark.range(1000).selectExpr("id", "case when id % 4 < 3 then repeat('a', cast(id % 4 as int)) end as text")
    got = per_value(rows, "text", {"n": slow(F.col("_value"))}).groupBy("text", "n").count().collect()
    assert sorted((r.n, r["count"]) for r in got) == [(-1, 250), (0, 250), (1, 250), (2, 250)]
    assert seen.value == 4


def test_spans_of_one_text_keep_their_own_geometry(spark):
    box = (10.0, 10.0, 70.0, 18.0, 0, 612.0, 792.0)
    rows = [(1, 1, 1, "enter your password", 1.0, *box), (1, 1, 2, "enter your password", 9.0, *box), (1, 1, 3, " ", 1.0, *box), (2, 1, 4, None, 1.0, *box), (2, 1, 5, "enter your password", 9.0, *box)]
    pages = spark.createDataFrame([(1, 1, "enter your password"), (2, 1, "other words here")], "doc_id long, page int, ocr_text string")
    got = sorted((r.seq, r.reasons, r.visible_overlap) for r in pdfspans.findings(spark.createDataFrame(rows, SPAN), pages).collect())
    assert got == [(1, ["very-small-font"], 1.0), (5, ["not-visible-in-rendered-page"], 0.0)]


def test_unread_descriptions_are_not_made(spark):
    facts = spark.createDataFrame([(1, True, 2, "threat", "x")], "doc_id long, extension_mismatch boolean, n int, av_status string, av_details string").withColumns({"extension": F.lit(".a"), "detected_type": F.lit("pdf")})
    rows = evidence.apply_rules(facts, evidence.GENERIC, "doc_id")
    assert [(r.rule_id, r.description) for r in rows.collect()] == [("G-1", "named .a, content is pdf"), ("G-2", "x")]
    plan = rows.select("rule_id", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan
