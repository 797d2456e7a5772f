"""Queries on scoring, verdict tables, the whole scan, verification and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog import binary_queries as B
from docrisk.catalog import json_queries as J
from docrisk.catalog import office_queries as O
from docrisk.catalog import pdf_queries as D
from docrisk.catalog.core import hit, names, query
from docrisk.catalog.identity_queries import DETECTED_SQL, EXPECTED_SQL
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import binary, evidence, identity, jsonnodes, office, pdfspans, report, scoring, verdicts, verify
from docrisk.plans import scan as plan
from docrisk.session import work_folder

LEVEL = "case when {s} >= 75 then 'critical' when {s} >= 50 then 'high' when {s} >= 25 then 'medium' else 'low' end"
VERDICT = "case when {s} >= 50 then 'block' when {s} >= 25 then 'review' else 'allow' end"
_SIDE = f"with f as (select file_id, sha256, {EXPECTED_SQL} as e, {DETECTED_SQL} as d from {{fx_files}}), v as (select f.*, coalesce(a.status, 'unavailable') as av, coalesce(e <> d, false) as mm from f left join {{fx_av}} a on a.sha256 = f.sha256)"
_GENERIC = "select file_id, 'G-1' as rule_id, 15 as score from v where mm union all select file_id, 'G-2', 50 from v where av = 'threat' union all select file_id, 'G-3', 5 from v where av = 'unavailable'"


def _identified(x: Inputs) -> DataFrame:
    out = identity.mismatch(identity.detect_type(verdicts.attach(x.fx_files, x.fx_av)))
    return out.withColumn("extension", identity.extension(F.col("filename")))


@query("verdict_attach", "V-10", _SIDE + " select file_id, av as av_status, av in ('clean', 'threat') as av_available from v")
def attach(x: Inputs) -> DataFrame:
    return verdicts.attach(x.fx_files, x.fx_av).select("file_id", "av_status", "av_available")


@query(
    "verdict_details", "V-10",
    "select doc_id, case when doc_id % 2 = 0 then concat(source, ' FOUND') else trim(source) end as details from {documents}",
)
def details(x: Inputs) -> DataFrame:
    """Scanner output lines with a local path, without it."""
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/tmp/a: b/x.pdf: "), "source", F.lit(" FOUND\n"))).otherwise(F.col("source"))
    return x.documents.select("doc_id", verdicts.clean_details(line).alias("details"))


@query("generic_evidence", "G-1, G-2, G-3", _SIDE + " " + _GENERIC)
def generic_evidence(x: Inputs) -> DataFrame:
    return evidence.apply_rules(_identified(x), evidence.GENERIC, "file_id").select("file_id", "rule_id", "score")


_SUM = _SIDE + f", ev as ({_GENERIC}), r as (select f.file_id, least(coalesce(sum(score), 0), 100) as s from f left join ev on ev.file_id = f.file_id group by 1)"


@query("risk_score", "V-1, V-2", _SUM + f" select file_id, cast(s as int) as risk_score, {LEVEL.replace('{s}', 's')} as risk_level, {VERDICT.replace('{s}', 's')} as base_verdict from r")
def risk_score(x: Inputs) -> DataFrame:
    rows = evidence.apply_rules(_identified(x), evidence.GENERIC, "file_id")
    out = scoring.risk(rows, x.fx_files.select("file_id"), "file_id")
    return out.withColumn("base_verdict", scoring.base_verdict(F.col("risk_score")))


@query(
    "risk_bands", "V-2",
    f"select scan_id, {LEVEL.replace('{s}', 'risk_score')} as risk_level, {VERDICT.replace('{s}', 'risk_score')} as base_verdict from {{fx_scans}}",
)
def risk_bands(x: Inputs) -> DataFrame:
    score = F.col("risk_score")
    return x.fx_scans.select("scan_id", scoring.level(score).alias("risk_level"), scoring.base_verdict(score).alias("base_verdict"))


@query(
    "scan_uninspected", "V-12",
    rf"""with t as (select file_id, filename, {DETECTED_SQL} as d from {{fx_files}})
    select file_id, case when coalesce(d in ('pdf', 'exe', 'docx', 'docm', 'json'), false) or regexp_matches(filename, '(?i)\.(exe|docx|docm|json)$')
      then 'content inspected' else 'content not inspected' end as inspection from t""",
)
def uninspected(x: Inputs) -> DataFrame:
    return scoring.uninspected(identity.route(identity.detect_type(x.fx_files))).select("file_id", "inspection")


# Reports per document; copies of a document add up under their common hash.
_REP = "select sha2(text,256) as sha256, case when doc_id % 6 = 0 then 'malware' when doc_id % 6 < 3 then 'suspicious' else 'clean' end as report from {documents} where doc_id % 2 = 0"


@query(
    "verdict_reputation", "V-11",
    _SUM + f""", rep as (select sha256, count(*) filter (report = 'malware') as m, count(*) filter (report = 'suspicious') as s from ({_REP.replace('sha2(text,256)', 'sha256(text)')}) group by 1),
    l as (select f.file_id, {LEVEL.replace('{s}', 'r.s')} as lvl, case when m >= 2 then 'critical' when m = 1 then 'high' when rep.s > 0 then 'medium' when m is not null then 'low' end as said
      from f join r on r.file_id = f.file_id left join rep on rep.sha256 = f.sha256)
    select file_id, coalesce(said, 'unknown') as reputation, case when list_position(['low', 'medium', 'high', 'critical'], said) > list_position(['low', 'medium', 'high', 'critical'], lvl)
      then said else lvl end as fused_level from l""",
)
def reputation(x: Inputs) -> DataFrame:
    scored = evidence.with_evidence(_identified(x), evidence.GENERIC).withColumn("risk_level", scoring.level(scoring.array_score(F.col("evidence"))))
    return verdicts.reputation(scored, x.sql(_REP)).select("file_id", "reputation", "fused_level")


# ---- plain texts: the flagship ------------------------------------------------------------------
_TEXT = f"""with t as (select doc_id, sha256(text) as sha256, {names([(hit('text', P.INJECT_JSON[n]), n) for n in sorted(P.INJECT_JSON)])} as inject,
    {names([(hit('text', P.SECRETS[n], ''), n) for n in sorted(P.SECRETS)])} as secrets from {{fx_seeded}}),
  v as (select t.*, coalesce(a.status, 'unavailable') as av from t left join {{fx_av}} a on a.sha256 = t.sha256),
  r as (select *, least(100, case when inject <> '' then 20 else 0 end + case when secrets <> '' then 25 else 0 end + case av when 'threat' then 50 when 'unavailable' then 5 else 0 end) as s from v)"""


@query("text_scan", "V-9, S-1, EJ-3, EJ-5, G-2, G-3", _TEXT + f" select doc_id, av as av_status, secrets as secret_kinds, cast(s as int) as risk_score, {LEVEL.replace('{s}', 's')} as risk_level from r")
def text_scan(x: Inputs) -> DataFrame:
    return plan.text_scan(x.fx_seeded, x.fx_av).select("doc_id", "av_status", F.array_join("secret_kinds", ",").alias("secret_kinds"), "risk_score", "risk_level")


@query(
    "text_levels", "V-1, V-2, V-9, V-10",
    _TEXT.replace("{fx_seeded}", "{documents}") + f" select {LEVEL.replace('{s}', 's')} as risk_level, av as av_status, count(*) as documents, cast(sum(s) as bigint) as total_score from r group by 1, 2",
)
def text_levels(x: Inputs) -> DataFrame:
    """Flagship: the given documents scored and counted by level and antivirus status."""
    scored = plan.text_scan(x.documents.select("doc_id", "text"), x.fx_av)
    return scored.groupBy("risk_level", "av_status").agg(F.count(F.lit(1)).alias("documents"), F.sum("risk_score").cast("bigint").alias("total_score"))


# ---- the whole scan -----------------------------------------------------------------------------
FORMATS = ("pdf", "exe", "docx", "json")


def all_tables(x: Inputs, ids: dict[str, DataFrame] | None = None) -> plan.Tables:
    """Fact tables of the four formats. The given tables hold rows of many more files than there are: each table is cut
    to the files that take its route, or to ``ids`` by format, before the costly work on its rows. The lines, which most
    tables are views of, are cut first and stored: else each view would read, deal out and cut all of them."""
    ids = ids or {r: plan.routed(x.fx_files, f"route_{r}") for r in FORMATS}
    x = x.with_table("lineitem", lines_of(x, reduce(DataFrame.union, ids.values())))
    pick = lambda name, route, key: plan.only(x[name], ids[route], key)
    strings = pick("fx_seeded", "exe", "doc_id").select(F.col("doc_id").alias("file_id"), F.array("text").alias("strings"))
    return plan.Tables(
        pdf=tuple(pick(n, "pdf", "doc_id") for n in ("fx_pdf_objects", "fx_pdf_spans", "fx_pdf_pages")),
        exe=(*[pick(n, "exe", "file_id") for n in ("fx_pe_headers", "fx_pe_sections", "fx_pe_imports")], binary.behaviours(strings).drop("strings")),
        docx=tuple(pick(n, "docx", "doc_id") for n in ("fx_ooxml_full", "fx_ooxml_runs", "fx_ooxml_rels", "fx_xml_parts")),
        json=scoring.validate_facts(jsonnodes.facts(jsonnodes.parse(pick("fx_json_docs", "json", "doc_id")))),
    )


def lines_of(x: Inputs, ids: DataFrame) -> DataFrame:
    """The lines of some files, stored."""
    path = work_folder(x.spark, "lines") + "/table"
    lines = plan.only(x.lineitem, ids, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines.write.parquet(path)
    return x.spark.read.schema(lines.schema).parquet(path)


def full_scan(x: Inputs) -> DataFrame:
    return plan.scan_tables(x.fx_files, x.fx_av, all_tables(x))


def _part(prefix: str, sql: str, key: str, cols: str) -> str:
    """One format's facts and evidence as a single materialised sub-query."""
    return f"{prefix} as ({sql} select {key} as file_id, {cols} from facts f left join (select {key} as k, sum({{n}}score) as total, bool_or(severity in ('high', 'critical')) as high, bool_or(rule_id = 'EP-21' and severity = 'high') as hid from ev group by 1) e on e.k = f.{key})"


_SCAN = (
    "with "
    + ", ".join(
        [
            _part("pdf", D._DOCS + D.EVIDENCE, "doc_id", "total, hid").replace("{n}", "occurrences * "),
            _part("exe", B.FACTS + B.EVIDENCE, "file_id", "supported, total, high, warnings").replace("{n}", ""),
            _part("docx", O.FACTS + O.EVIDENCE, "doc_id", "supported, total, high, warnings <> '' or hidden_count > 0 or embedded > 0 or macros > 0 or has_external_template or coalesce(indicators, '') <> '' as flagged").replace("{n}", ""),
            _part("js", J.FACTS + J.EVIDENCE, "doc_id", "supported, total, indicators").replace("{n}", ""),
        ]
    )
    + rf""", f as (select fi.file_id, fi.sha256, filename, {EXPECTED_SQL} as e, case when {DETECTED_SQL} = 'zip' and coalesce(docx.supported, false) then 'docx' else {DETECTED_SQL} end as d
      from {{fx_files}} fi left join docx on docx.file_id = fi.file_id),
    v as (select f.*, coalesce(a.status, 'unavailable') as av, coalesce(e <> d, false) as mm, coalesce(d = 'pdf', false) as rp, coalesce(d = 'exe', false) or regexp_matches(filename, '(?i)\.exe$') as rx,
      coalesce(d in ('docx', 'docm'), false) or regexp_matches(filename, '(?i)\.(docx|docm)$') as rd, coalesce(d = 'json', false) or regexp_matches(filename, '(?i)\.json$') as rj
      from f left join {{fx_av}} a on a.sha256 = f.sha256),
    w as (select v.*, case when mm then 15 else 0 end + case av when 'threat' then 50 when 'unavailable' then 5 else 0 end
        + case when rp then coalesce(pdf.total, 0) else 0 end + case when rx then case when exe.file_id is null then 18 else coalesce(exe.total, 0) end else 0 end
        + case when rd then case when docx.file_id is null then 20 else coalesce(docx.total, 0) end else 0 end + case when rj then case when js.file_id is null then 10 else coalesce(js.total, 0) end else 0 end as raw,
        rp and coalesce(pdf.hid, false) as hid, coalesce(exe.supported, false) as xs, coalesce(exe.high, exe.file_id is null) as xh, coalesce(exe.warnings, '') as xw,
        coalesce(docx.supported, false) as ds, coalesce(docx.high, docx.file_id is null) as dh, coalesce(docx.flagged, true) as df, coalesce(js.supported, false) as js_ok, coalesce(js.indicators, 'x') as ji
      from v left join pdf on pdf.file_id = v.file_id left join exe on exe.file_id = v.file_id left join docx on docx.file_id = v.file_id left join js on js.file_id = v.file_id),
    z as (select *, least(raw, 100) as s from w)
    select file_id, d as detected_type, av as av_status, cast(s as int) as risk_score, {LEVEL.replace('{s}', 's')} as risk_level,
      case when rx then case when av = 'threat' then 'block' when av <> 'clean' or not xs or mm or xw <> '' or xh or s >= 25 then 'review' else 'allow' end
       when rd then case when av = 'threat' then 'block' when av <> 'clean' or not ds or mm or dh or df or s >= 15 then 'review' else 'allow' end
       when rj then case when av = 'threat' then 'block' when av <> 'clean' or not js_ok or mm or ji <> '' or s >= 15 then 'review' else 'allow' end
       when s >= 50 then 'block' when s >= 25 or hid then 'review' else 'allow' end as verdict from z"""
)


@query("scan_result", "V-8, V-9, V-4, V-5, V-6, V-7, U-1, Q-1, Q-4", _SCAN)
def scan_result(x: Inputs) -> DataFrame:
    return full_scan(x).select("file_id", "detected_type", "av_status", "risk_score", "risk_level", "verdict")


# ---- verification and reports -------------------------------------------------------------------
_QUOTES = """select doc_id as item_id, 'body' as part, case when doc_id % 3 = 0 then 'no such words here' when doc_id % 3 = 1 then substring(text, 5, 12) else substring(text, 1, 9) end as quote,
 cast(case when doc_id % 3 = 1 then 5 when doc_id % 3 = 2 then 2 end as int) as start_pos, lang from {documents}"""
_CHECKED = f"""with p as ({_QUOTES}), c as (select p.*, coalesce(length(quote) > 0 and case when start_pos is not null then substring(text, start_pos, cast(length(quote) as int)) = quote else contains(text, quote) end, false) as verified
 from p left join {{documents}} d on d.doc_id = p.item_id)"""


@query("verify_findings", "V-13", _CHECKED + " select item_id, verified from c")
def verify_findings(x: Inputs) -> DataFrame:
    texts = x.fx_texts.where(F.col("src") == "documents")
    return verify.findings(x.sql(_QUOTES), texts).select("item_id", "verified")


@query("verify_rate", "V-13", _CHECKED + " select lang, count(*) as findings, count(*) filter (not verified) as unverified, count(*) filter (not verified) / count(*) as hallucination_rate from c group by lang")
def verify_rate(x: Inputs) -> DataFrame:
    texts = x.fx_texts.where(F.col("src") == "documents")
    return verify.hallucination_rate(verify.findings(x.sql(_QUOTES), texts), "lang")


@query(
    "report_lines", "V-14",
    D.SPANS + """select doc_id, page, seq, concat('MEDIUM: hidden text found on page ', cast(page as string), ' containing "', text, '".') as line from found""",
)
def report_lines(x: Inputs) -> DataFrame:
    found = pdfspans.shown(pdfspans.findings(x.fx_pdf_spans, x.fx_pdf_pages))
    rows = found.select(
        "doc_id", "page", "seq", F.lit("medium").alias("severity"), F.lit("Hidden text").alias("title"),
        F.concat(F.lit("page "), F.col("page").cast("string")).alias("location"), F.col("text").alias("quote"),
    )
    return report.lines(rows).select("doc_id", "page", "seq", "line")

