"""Queries on page documents and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import hit, in_list, names, query
from docrisk.catalog.signal_queries import _COMPARE, _PDF_SIGNAL_PAIRS, _ZW
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import evidence, pdfspans, scoring

_TOK = lambda c: f"list_filter(string_split({_COMPARE.replace('text', c)}, ' '), lambda t: t <> '')"
_SET = lambda c: f"list_distinct(list_filter(string_split({_COMPARE.replace('text', c)}, ' '), lambda t: length(t) >= 2))"
_LIGHT = " and ".join(f"((color >> {n}) & 255) >= {P.PDF_LIGHT}" for n in (16, 8, 0))
_TESTS = {
    "near-zero-bounding-box": "abs(x1 - x0) <= 0.1 or abs(y1 - y0) <= 0.1",
    "not-visible-in-rendered-page": "coalesce(ocr_text, '') <> '' and words >= 2 and overlap < 0.20",
    "outside-page-boundary": "x1 < -2.0 or x0 > page_w + 2.0 or y1 < -2.0 or y0 > page_h + 2.0",
    "very-light-text": _LIGHT,
    "very-small-font": "font_size > 0 and font_size < 2.0",
    "zero-width-characters": hit("text", _ZW, ""),
}
_BASE = " + ".join(f"case when {_TESTS[r]} then {w} else 0 end" for r, w in pdfspans.REASONS.items())
_SIG = {n: c for c, n in _PDF_SIGNAL_PAIRS}
_BONUS = " + ".join(f"case when {_SIG[s]} then {w} else 0 end" for s, w in pdfspans.BONUS.items())
SPANS = f"""with raw as (select s.*, p.ocr_text, cast(len({_TOK('s.text')}) as int) as words,
    coalesce(len(list_intersect({_SET('s.text')}, {_SET('p.ocr_text')})) / nullif(len({_SET('s.text')}), 0), 0.0) as overlap
  from {{fx_pdf_spans}} s left join {{fx_pdf_pages}} p on p.doc_id = s.doc_id and p.page = s.page where regexp_matches(s.text, '\\S')),
flagged as (select *, {names([(f"({_TESTS[r]})", r) for r in sorted(_TESTS)])} as reasons, cast({_BASE} as double) as base_confidence from raw),
found as (select *, {names(_PDF_SIGNAL_PAIRS)} as signals, least(round(base_confidence + cast({_BONUS} as double), 3), 1.0) as confidence
  from flagged where reasons <> '')
"""


@query("pdf_reasons", "P-1", SPANS + "select doc_id, page, seq, reasons, round(base_confidence, 6) as base_confidence, round(overlap, 6) as overlap from flagged")
def reasons(x: Inputs) -> DataFrame:
    return pdfspans.reasons(x.fx_pdf_spans, x.fx_pdf_pages).select(
        "doc_id", "page", "seq", F.array_join("reasons", ",").alias("reasons"), F.round("base_confidence", 6).alias("base_confidence"),
        F.round("visible_overlap", 6).alias("overlap"),
    )


@query("pdf_rgb", "P-2", f"select doc_id, seq, (color >> 16) & 255 as red, (color >> 8) & 255 as green, color & 255 as blue, {_LIGHT} as is_light from {{fx_pdf_spans}}")
def rgb(x: Inputs) -> DataFrame:
    return x.fx_pdf_spans.select("doc_id", "seq", pdfspans.rgb(F.col("color")).alias("c"), pdfspans.is_light(F.col("color")).alias("is_light")).select(
        "doc_id", "seq", "c.red", "c.green", "c.blue", "is_light"
    )


@query("pdf_findings", "P-3, T-15", SPANS + "select doc_id, page, seq, signals, confidence from found")
def findings(x: Inputs) -> DataFrame:
    return pdfspans.findings(x.fx_pdf_spans, x.fx_pdf_pages).select("doc_id", "page", "seq", F.array_join("signals", ",").alias("signals"), "confidence")


# Few large documents with thousands of findings each.
_BIG_SPANS = "select doc_id % 20 as doc_id, page, doc_id * 8 + seq as seq, text, font_size, x0, y0, x1, y1, color, page_w, page_h from {fx_pdf_spans}"
_BIG_PAGES = "select distinct doc_id % 20 as doc_id, page, 'please enter your password see mail' as ocr_text from {fx_pdf_pages}"


@query(
    "pdf_capped", "P-4",
    SPANS.replace("{fx_pdf_spans}", f"({_BIG_SPANS})").replace("{fx_pdf_pages}", f"({_BIG_PAGES})") + "select doc_id, page, seq, confidence from found",
)
def capped(x: Inputs) -> DataFrame:
    """All findings are shown; a limit is an argument of the display."""
    return pdfspans.shown(pdfspans.findings(x.sql(_BIG_SPANS), x.sql(_BIG_PAGES))).select("doc_id", "page", "seq", "confidence")


@query(
    "pdf_overlapping_spans", "P-5",
    """select a.doc_id, a.page, a.seq as a_seq, b.seq as b_seq from {fx_pdf_spans} a join {fx_pdf_spans} b
    on a.doc_id = b.doc_id and a.page = b.page and a.seq < b.seq
    where not (a.x1 <= b.x0 or b.x1 <= a.x0 or a.y1 <= b.y0 or b.y1 <= a.y0)""",
)
def overlapping_spans(x: Inputs) -> DataFrame:
    return pdfspans.overlapping(x.fx_pdf_spans)


_KINDS = {
    "acroform": "contains(low, '/acroform')", "additional-actions": r"regexp_matches(low, '/aa\b')", "embedded-file": "contains(low, '/embeddedfile')",
    "javascript": r"regexp_matches(low, '/(?:javascript|js)\b')", "launch": "contains(low, '/launch')", "richmedia": "contains(low, '/richmedia')",
    "xfa": "contains(low, '/xfa')",
}
_ATT = "(contains(low, '/embeddedfile'))"
_PROV = "(contains(low, 'c2pa') or contains(low, 'content credentials') or contains(low, 'content-credentials'))"
_NAME = r"nullif(regexp_extract(object_text, '(?is)/F\s*\((.*?)\)', 1), '')"
_MIME = r"nullif(trim(replace(replace(regexp_extract(object_text, '(?i)/Subtype\s*/([^\s<>\[\]()]+)', 1), '#2F', '/'), '#20', ' ')), '')"
_SUFFIX = "(" + "|".join(e.replace(".", "\\.") for e in P.PDF_EXECUTABLE) + ")$"
_EXEC = f"({hit(f'lower(trim({_NAME}))', _SUFFIX, '')} or coalesce(lower({_MIME}) in {in_list(P.PDF_EXECUTABLE_MIME)}, false))"
OBJECTS = "with o as (select *, lower(object_text) as low from {fx_pdf_objects})"
_FLAGS = f"""select doc_id, count(*) filter ({_KINDS['javascript']}) as javascript_count, bool_or({_KINDS['additional-actions']}) as has_additional_actions,
  bool_or({_KINDS['launch']}) as has_launch, bool_or({_KINDS['richmedia']}) as has_rich_media, bool_or({_KINDS['acroform']}) as has_acroform,
  bool_or({_KINDS['xfa']}) as has_xfa, count(*) filter ({_ATT}) as attachment_count, count(*) filter ({_ATT} and {_PROV}) as provenance_count,
  count(*) filter ({_ATT} and not {_PROV} and {_EXEC}) as executable_attachments,
  count(*) filter ({_ATT} and not {_PROV} and not {_EXEC}) as other_attachments from o group by doc_id"""


@query("pdf_object_flags", "P-6", OBJECTS + " " + _FLAGS)
def object_flags(x: Inputs) -> DataFrame:
    return pdfspans.object_flags(x.fx_pdf_objects)


@query(
    "pdf_suspicious", "P-7",
    SPANS.rstrip() + ", o as (select *, lower(object_text) as low from {fx_pdf_objects}) "
    + " union ".join(f"select doc_id, xref, '{k}' as type from o where {c}" for k, c in _KINDS.items())
    + " union select doc_id, 0, 'hidden-text' from found",
)
def suspicious(x: Inputs) -> DataFrame:
    hidden = pdfspans.findings(x.fx_pdf_spans, x.fx_pdf_pages).select("doc_id")
    return pdfspans.suspicious(x.fx_pdf_objects, hidden).select("doc_id", "xref", "type")


_ACT = lambda c: f"nullif(regexp_extract({c}, '(?i)/S\\s*/([A-Za-z0-9]+)', 1), '')"
_PAREN = lambda c, k: f"nullif(regexp_extract({c}, '(?is)/{k}\\s*\\((.*?)\\)', 1), '')"


@query(
    "pdf_open_action", "P-8",
    r"""with cat as (select doc_id, arg_min(object_text, xref) as c from {fx_pdf_refs} where regexp_matches(object_text, '/Type\s*/Catalog\b') group by 1),
    r as (select doc_id, try_cast(nullif(regexp_extract(c, '(?i)/OpenAction\s+(\d+)\s+\d+\s+R', 1), '') as bigint) as ref,
      nullif(regexp_extract(c, '(?i)/OpenAction\s*<<([\s\S]*?)>>', 1), '') as inl from cat),
    b as (select r.doc_id, r.ref is not null as by_ref, coalesce(case when r.ref is null then inl end, o.object_text) as body
      from r left join {fx_pdf_refs} o on o.doc_id = r.doc_id and o.xref = r.ref where r.ref is not null or inl is not null),"""
    + f"""a as (select doc_id, body, {_ACT('body')} as raw from b),
    k as (select *, case when raw in {in_list(P.PDF_ACTIONS)} then raw else 'Unknown' end as kind from a)
    select doc_id, kind as action_type, raw as action_raw_type, case kind when 'URI' then {_PAREN('body', 'URI')} when 'Launch' then {_PAREN('body', 'F')}
      when 'JavaScript' then {_PAREN('body', 'JS')} when 'GoTo' then 'internal document destination'
      when 'GoToR' then coalesce({_PAREN('body', 'F')}, 'remote document destination') end as action_target from k""",
)
def open_action(x: Inputs) -> DataFrame:
    return pdfspans.open_action(x.fx_pdf_refs)


@query(
    "pdf_attachments", "P-9",
    OBJECTS + f""" select doc_id, xref, {_NAME} as attachment_name, {_MIME} as mime_type,
      try_cast(nullif(regexp_extract(object_text, '(?i)/Length\\s+(\\d+)', 1), '') as bigint) as attachment_size, {_PROV} as is_provenance, {_EXEC} as is_executable
    from o where {_ATT}""",
)
def attachments(x: Inputs) -> DataFrame:
    return pdfspans.attachments(x.fx_pdf_objects).drop("relationship")


# Pages with the derived link, annotation and form columns.
_RICH = """select *, cast(doc_id % 3 as int) as annotations, case when doc_id % 5 = 0 then 2 else 0 end as form_fields,
 case when doc_id % 2 = 0 then {list}('http://a.example', concat('http://p.example/', cast(page as string))) else {list}('') end as urls from {{fx_pdf_pages}}"""


@query(
    "pdf_page_facts", "P-10",
    "with p as (" + _RICH.format(list="list_value") + """), u as (select doc_id, count(distinct url) as url_count from (select doc_id, unnest(urls) as url from p) where url <> '' group by 1)
    select p.doc_id, count(*) as page_count, cast(sum(native_len) as bigint) as text_length, cast(sum(annotations) as bigint) as annotation_count,
      cast(sum(form_fields) as bigint) as form_field_count, coalesce(any_value(url_count), 0) as url_count
    from p left join u on u.doc_id = p.doc_id group by p.doc_id""",
)
def page_facts(x: Inputs) -> DataFrame:
    return pdfspans.page_facts(x.sql(_RICH.format(list="array").replace("{{", "{").replace("}}", "}")))


_SCANNED = "select doc_id % 50 as doc_id, doc_id * 4 + page as page, case when doc_id % 50 < 10 then '' else ocr_text end as ocr_text, case when doc_id % 50 % 6 = 0 then 0 else native_len end as native_len from {fx_pdf_pages}"


@query(
    "pdf_text_source", "P-11",
    "with p as (" + _SCANNED + f"""), n as (select * from p where native_len = 0),
    r as (select doc_id, count(*) filter (trim(ocr_text) <> '') as good, count(*) filter (trim(ocr_text) = '') as bad, sum(length(trim(ocr_text))) as chars
      from n group by 1),
    b as (select doc_id, sum(native_len) as native_length, count(*) filter (native_len = 0) as need from p group by 1)
    select b.doc_id, cast(need as bigint) as pages_without_text, need > 0 as ocr_attempted, coalesce(good, 0) as ocr_page_count,
      cast(coalesce(bad, 0) as bigint) as ocr_errors, need > {P.PDF_OCR_PAGES} as ocr_page_limit_reached,
      case when native_length > 0 and coalesce(chars, 0) > 0 then 'mixed' when native_length > 0 then 'native' when coalesce(chars, 0) > 0 then 'ocr' else 'none' end as text_source
    from b left join r on r.doc_id = b.doc_id""",
)
def text_source(x: Inputs) -> DataFrame:
    return pdfspans.text_source(x.sql(_SCANNED)).select("doc_id", "pages_without_text", "ocr_attempted", "ocr_page_count", "ocr_errors", "ocr_page_limit_reached", "text_source")


_WORDS = "select conv_id as doc_id, turn as page, 0 as base, text from {conversations}"


@query(
    "pdf_ocr_text", "P-12",
    r"""select conv_id as doc_id, turn as page, cast(len(list_filter(string_split(text, ' '), lambda w: trim(w) <> '')) as int) as word_count,
    sha256(array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: trim(w) <> ''), lambda w: trim(w)), ' ')) as text_sha
    from {conversations} where len(list_filter(string_split(text, ' '), lambda w: trim(w) <> '')) > 0""",
)
def ocr_text(x: Inputs) -> DataFrame:
    """Conversation turns as recognised words, put together again."""
    words = x.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    return pdfspans.ocr_text(words).select("doc_id", "page", "word_count", F.sha2("ocr_text", 256).alias("text_sha"))


@query(
    "pdf_metadata", "P-13",
    """select doc_id, case when doc_id % 3 = 0 then 1 else 0 end + case when coalesce(lang, '') <> '' then 1 else 0 end + case when coalesce(source, '') <> '' then 1 else 0 end as entries,
    concat_ws(',', case when doc_id % 3 = 0 then 'author' end, case when coalesce(lang, '') <> '' then 'lang' end, case when coalesce(source, '') <> '' then 'source' end) as keys from {documents}""",
)
def metadata(x: Inputs) -> DataFrame:
    raw = x.documents.select(
        "doc_id", F.create_map(F.lit("author"), F.when(F.col("doc_id") % 3 == 0, F.lit("a")).otherwise(F.lit("")), F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata")
    )
    out = pdfspans.metadata(raw)
    return out.select("doc_id", F.size("metadata").alias("entries"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


# ---- facts and evidence -----------------------------------------------------------------------
_DOCS = SPANS.rstrip() + ", o as (select *, lower(object_text) as low from {fx_pdf_objects}), fl as (" + _FLAGS + r"""),
cat as (select doc_id, arg_min(object_text, xref) as c from {fx_pdf_objects} where regexp_matches(object_text, '/Type\s*/Catalog\b') group by 1),
act as (select doc_id, """ + _ACT("c") + r""" as action_type from cat),
need as (select * from {fx_pdf_pages} where native_len = 0),
ocr as (select doc_id, count(*) filter (ocr_text <> '') as good, count(*) filter (ocr_text = '') as bad from need group by 1),
pg as (select doc_id, sum(native_len) as native_length from {fx_pdf_pages} group by 1),
hid as (select doc_id, count(*) as hidden_count, bool_or(regexp_matches(signals, 'prompt-injection|command-execution|credential-request|possible-obfuscation')) as bad_text from found group by 1),
facts as (select fl.*, action_type, coalesce(hidden_count, 0) as hidden_count, coalesce(bad_text, false) as hidden_suspicious,
  case when native_length > 0 and coalesce(good, 0) > 0 then 'mixed' when native_length > 0 then 'native' when coalesce(good, 0) > 0 then 'ocr' else 'none' end as text_source,
  good is not null as ocr_attempted, coalesce(bad, 0) as ocr_errors
  from fl join pg on pg.doc_id = fl.doc_id left join act on act.doc_id = fl.doc_id left join ocr on ocr.doc_id = fl.doc_id left join hid on hid.doc_id = fl.doc_id)
"""
_FACT_COLS = (
    "doc_id", "action_type", "hidden_count", "hidden_suspicious", "text_source", "ocr_attempted", "ocr_errors", "javascript_count", "has_launch",
    "has_xfa", "attachment_count", "executable_attachments",
)


def _facts(x: Inputs) -> DataFrame:
    return pdfspans.facts(x.fx_pdf_objects, x.fx_pdf_spans, x.fx_pdf_pages)


@query("pdf_facts", "P-14", _DOCS + "select " + ", ".join(_FACT_COLS) + " from facts")
def facts(x: Inputs) -> DataFrame:
    return _facts(x).select(*_FACT_COLS)


_RULES = {
    "EP-1": ("javascript_count > 0", "'high'", "20"), "EP-2": ("action_type = 'GoTo'", "'low'", "0"), "EP-3": ("action_type = 'GoToR'", "'medium'", "5"),
    "EP-4": ("action_type = 'URI'", "'low'", "2"), "EP-5": ("action_type = 'JavaScript'", "'high'", "20"), "EP-6": ("action_type = 'Launch'", "'high'", "25"),
    "EP-8": ("has_additional_actions", "'medium'", "10"), "EP-9": ("has_launch and coalesce(action_type, '') <> 'Launch'", "'high'", "25"),
    "EP-10": ("provenance_count > 0", "'low'", "0"), "EP-11": ("executable_attachments > 0", "'high'", "25"), "EP-12": ("other_attachments > 0", "'medium'", "5"),
    "EP-13": ("has_rich_media", "'medium'", "10"), "EP-14": ("has_xfa", "'medium'", "8"), "EP-16": ("text_source = 'ocr' and ocr_attempted", "'low'", "2"),
    "EP-18": ("ocr_attempted and ocr_errors > 0", "'medium'", "4"), "EP-20": ("has_acroform", "'low'", "1"),
    "EP-21": ("hidden_count > 0", "case when hidden_suspicious then 'high' else 'medium' end", "case when hidden_suspicious then 20 else 8 end"),
}
_TIMES = {"EP-11": "executable_attachments", "EP-12": "other_attachments"}
# Category and source by rule, written out again for the check.
_ORIGIN = {
    "EP-1": ("pdf-security", "pdf-structure-analysis"), "EP-2": ("pdf-navigation", "pdf-openaction-analysis"), "EP-3": ("pdf-navigation", "pdf-openaction-analysis"),
    "EP-4": ("pdf-navigation", "pdf-openaction-analysis"), "EP-5": ("pdf-security", "pdf-openaction-analysis"), "EP-6": ("pdf-security", "pdf-openaction-analysis"),
    "EP-7": ("pdf-security", "pdf-openaction-analysis"), "EP-8": ("pdf-security", "pdf-structure-analysis"), "EP-9": ("pdf-security", "pdf-structure-analysis"),
    "EP-10": ("pdf-provenance", "pdf-embedded-file-analysis"), "EP-11": ("pdf-security", "pdf-embedded-file-analysis"), "EP-12": ("pdf-security", "pdf-embedded-file-analysis"),
    "EP-13": ("pdf-security", "pdf-structure-analysis"), "EP-14": ("pdf-security", "pdf-structure-analysis"), "EP-15": ("pdf-links", "pdf-link-analysis"),
    "EP-16": ("pdf-text", "pdf-ocr"), "EP-17": ("pdf-text", "pdf-ocr"), "EP-18": ("pdf-text", "pdf-ocr"), "EP-19": ("pdf-forms", "pdf-structure-analysis"),
    "EP-20": ("pdf-forms", "pdf-structure-analysis"), "EP-21": ("pdf-hidden-text", "pdf-hidden-text-analysis"),
}
EVIDENCE = ", ev as (" + " union all ".join(
    f"select doc_id, '{r}' as rule_id, '{_ORIGIN[r][0]}' as category, '{_ORIGIN[r][1]}' as source, {sev} as severity, {score} as score, cast({_TIMES.get(r, '1')} as bigint) as occurrences from facts where {when}"
    for r, (when, sev, score) in _RULES.items()
) + ") "


@query(
    "pdf_evidence", "EP-1, EP-4, EP-8, EP-9, EP-10, EP-11, EP-12, EP-13, EP-14, EP-16, EP-18, EP-20, EP-21, EV-1, EV-2",
    _DOCS + EVIDENCE + "select doc_id, rule_id, category, source, severity, score, occurrences from ev",
)
def pdf_evidence(x: Inputs) -> DataFrame:
    return evidence.apply_rules(_facts(x), evidence.PDF, "doc_id").select("doc_id", "rule_id", "category", "source", "severity", "score", "occurrences")


# Open actions of every type, links, forms and a missing OCR engine, on one facts row per order.
_ACTIONS = ("GoTo", "GoToR", "URI", "JavaScript", "Launch", "Unknown")
_VARIED = (
    "select o_orderkey as doc_id, case cast(o_custkey % 7 as int) "
    + " ".join(f"when {i} then '{a}'" for i, a in enumerate(_ACTIONS))
    + " end as action_type, o_custkey % 2 = 0 as has_launch, cast(o_custkey % 3 as bigint) as url_count, cast(o_custkey % 4 as bigint) as form_field_count, o_custkey % 5 = 0 as ocr_attempted from {orders}"
)
_VARIED_RULES = {r: _RULES[r] for r in ("EP-2", "EP-3", "EP-4", "EP-5", "EP-6", "EP-9")} | {
    "EP-7": ("action_type = 'Unknown'", "'medium'", "5"), "EP-15": ("url_count > 0", "'low'", "2"), "EP-17": ("ocr_attempted", "'medium'", "5"),
    "EP-19": ("form_field_count > 0", "'low'", "1"),
}


@query(
    "pdf_evidence_actions", "EP-2, EP-3, EP-4, EP-5, EP-6, EP-7, EP-9, EP-15, EP-17, EP-19",
    "with facts as (" + _VARIED + ") " + " union all ".join(
        f"select doc_id, '{r}' as rule_id, '{_ORIGIN[r][0]}' as category, '{_ORIGIN[r][1]}' as source, {sev} as severity, {score} as score from facts where {when}"
        for r, (when, sev, score) in _VARIED_RULES.items()
    ),
)
def pdf_evidence_actions(x: Inputs) -> DataFrame:
    rules = [r for r in evidence.PDF if r.rule_id in _VARIED_RULES]
    facts_ = x.sql(_VARIED).withColumns({
        "supported": F.lit(True), "action_target": F.lit("t"), "action_raw_type": F.lit("r"), "ocr_available": F.lit(False),
    })
    return evidence.apply_rules(facts_, rules, "doc_id").select("doc_id", "rule_id", "category", "source", "severity", "score")


@query(
    "pdf_attachment_evidence", "EP-10, EP-11, EP-12",
    OBJECTS + f""", a as (select doc_id, xref, {_PROV} as prov, {_EXEC} as exe from o where {_ATT})
    select doc_id, xref, case when exe then 'EP-11' else 'EP-12' end as rule_id, case when exe then 25 else 5 end as score from a where not prov
    union all select doc_id, min(xref), 'EP-10', 0 from a where prov group by doc_id""",
)
def pdf_attachment_evidence(x: Inputs) -> DataFrame:
    return evidence.attachment_rows(pdfspans.attachments(x.fx_pdf_objects)).select("doc_id", "xref", "rule_id", "score")


@query(
    "pdf_guard", "V-4, V-1, V-2",
    _DOCS + EVIDENCE + """, r as (select f.doc_id, least(coalesce(sum(score * occurrences), 0), 100) as score, coalesce(bool_or(rule_id = 'EP-21' and severity = 'high'), false) as hidden
      from facts f left join ev on ev.doc_id = f.doc_id group by f.doc_id)
    select doc_id, cast(score as int) as risk_score, case when score >= 75 then 'critical' when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end as risk_level,
      case when score >= 50 then 'block' when score >= 25 or hidden then 'review' else 'allow' end as verdict from r""",
)
def pdf_guard(x: Inputs) -> DataFrame:
    scored = evidence.with_evidence(_facts(x), evidence.PDF, described=False).withColumn("risk_score", scoring.array_score(F.col("evidence")))
    score = F.col("risk_score")
    return scored.select("doc_id", "risk_score", scoring.level(score).alias("risk_level"), scoring.pdf_guard(scoring.base_verdict(score), F.col("evidence")).alias("verdict"))


