"""Queries on word-processor packages and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import any_hit, hit, in_list, names, query, squeeze
from docrisk.catalog.signal_queries import _ZW
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import evidence, office, scoring

_HAS_TYPES = "coalesce(bool_or(name = '[Content_Types].xml'), false)"
_HAS_DOC = "coalesce(bool_or(name = 'word/document.xml'), false)"


def _limit(count: str = "count(*)", total: str = "sum(greatest(size, 0))") -> str:
    return (
        f"case when {count} > {P.DOCX_MAX_ENTRIES} then 'archive-entry-limit-exceeded' when {total} > {P.DOCX_MAX_EXPANDED} "
        f"then 'archive-expansion-limit-exceeded' when not ({_HAS_TYPES} and {_HAS_DOC}) then 'missing-required-office-parts' end"
    )


@query(
    "office_package_limits", "O-1",
    f"select doc_id, count(*) as entry_count, cast(sum(greatest(size, 0)) as bigint) as uncompressed_size, {_limit()} as limit_warning from {{fx_ooxml_entries}} group by doc_id",
)
def package_limits(x: Inputs) -> DataFrame:
    return office.package_limits(x.fx_ooxml_entries).drop("missing_parts")


@query(
    "office_missing_parts", "O-2",
    f"""with r as (select unnest([{", ".join(f"'{p}'" for p in P.DOCX_REQUIRED)}]) as missing_part), d as (select distinct doc_id from {{fx_ooxml_entries}})
    select d.doc_id, r.missing_part from d cross join r anti join {{fx_ooxml_entries}} e on e.doc_id = d.doc_id and e.name = r.missing_part""",
)
def missing_parts(x: Inputs) -> DataFrame:
    return office.missing_parts(x.fx_ooxml_entries)


_UNSAFE = "(starts_with(replace(name, '\\', '/'), '/') or list_contains(string_split(replace(name, '\\', '/'), '/'), '..') or regexp_matches(name, '^[a-zA-Z]:'))"
_WARN = [
    ("flag_bits & 1 = 1", "encrypted-archive-entry"),
    (f"size > {P.DOCX_RATIO_FLOOR} and compressed_size > 0 and size / greatest(compressed_size, 1) > {P.DOCX_MAX_RATIO}", "high-compression-ratio"),
    (f"size > {P.DOCX_ENTRY_LIMIT}", "oversized-package-entry"),
    (_UNSAFE, "suspicious-archive-path"),
]


@query("office_unsafe_paths", "O-3", f"select doc_id, seq, {_UNSAFE} as unsafe_path from {{fx_ooxml_entries}}")
def unsafe_paths(x: Inputs) -> DataFrame:
    return office.unsafe_paths(x.fx_ooxml_entries).select("doc_id", "seq", "unsafe_path")


@query("office_entry_warnings", "O-4", f"select doc_id, seq, {names(_WARN)} as warnings from {{fx_ooxml_entries}}")
def entry_warnings(x: Inputs) -> DataFrame:
    return office.entry_warnings(x.fx_ooxml_entries).select("doc_id", "seq", F.array_join("warnings", ",").alias("warnings"))


_EXE = f"regexp_matches(lower(name), '({'|'.join(s.replace('.', chr(92) + '.') for s in P.DOCX_EXECUTABLE)})$')"
_EMB = "(starts_with(lower(name), 'word/embeddings/') or contains(lower(name), '/embeddings/'))"
# Few packages with many entries, so that the caps matter.
_BIG = "select doc_id % 40 as doc_id, doc_id * 8 + seq as seq, case when name like 'word/%' then replace(name, '.bin', concat(cast(doc_id as string), '.bin')) else name end as name, size, compressed_size, flag_bits from {fx_ooxml_entries}"
_BIG = _BIG.replace("replace(name, '.bin', concat(cast(doc_id as string), '.bin'))", "replace(name, 'word/', concat('word/', cast(doc_id as string), '/'))")


@query(
    "office_components", "O-5",
    f"""select doc_id, bool_or({_EXE}) as has_executable_entry, count(distinct name) filter (contains(lower(name), 'vbaproject.bin')) as macro_count,
      count(*) filter ({_EMB}) as embedded_count, bool_or({_EMB} and {_EXE}) as embedded_executable from ({_BIG}) group by 1""",
)
def components(x: Inputs) -> DataFrame:
    return office.components(x.sql(_BIG))


@query(
    "office_component_rows", "O-5",
    f"""with e as ({_BIG}) select doc_id, name, 'macro' as kind, false as is_executable from e where contains(lower(name), 'vbaproject.bin') group by 1, 2
    union all select doc_id, name, 'embedded', {_EXE} from e where {_EMB}""",
)
def component_rows(x: Inputs) -> DataFrame:
    """Every macro part and embedded object."""
    big = x.sql(_BIG)
    macros = office.macro_parts(big).select("doc_id", "name", F.lit("macro").alias("kind"), F.lit(False).alias("is_executable"))
    return macros.unionByName(office.embedded_objects(big).select("doc_id", "name", F.lit("embedded").alias("kind"), "is_executable"))


@query(
    "office_part_counts", "O-6",
    "select doc_id, string_split(lower(name), '/')[-1] as base, count(*) as parts from {fx_ooxml_full} where regexp_matches(lower(name), '\\.(xml|rels)$') group by 1, 2",
)
def part_counts(x: Inputs) -> DataFrame:
    return office.part_counts(x.fx_ooxml_full)


_PART_WARN = [("bad", "malformed-or-unreadable-xml-part"), ("xml_parts > 300", "xml-part-count-limit-exceeded"), ("big", "xml-part-too-large-to-inspect")]


@query(
    "office_part_warnings", "O-7",
    f"""with a as (select doc_id, count(*) as xml_parts, bool_or(size > {P.DOCX_ENTRY_LIMIT}) as big, bool_or(size <= {P.DOCX_ENTRY_LIMIT} and broken) as bad from {{fx_xml_parts}} group by 1)
    select doc_id, xml_parts, {names(_PART_WARN)} as warnings from a""",
)
def part_warnings(x: Inputs) -> DataFrame:
    """Parts that are well formed, that break off, that declare a document type and that are too large."""
    return office.part_warnings(x.fx_xml_parts).select("doc_id", "xml_parts", F.array_join("warnings", ",").alias("warnings"))


_FILE = hit("target", P.DOCX_EXTERNAL_PATH)
_BIG_RELS = "select doc_id % 40 as doc_id, doc_id * 8 + seq as seq, target_mode, case when target like 'https:%' then concat(target, cast(doc_id % 400 as string)) else concat('  ', target, ' ') end as target, rel_type from {fx_ooxml_rels}"


@query(
    "office_external_rels", "O-8",
    f"""with e as (select *, trim(target) as t from ({_BIG_RELS}) where lower(target_mode) = 'external')
    select doc_id, count(*) as external_count, count(*) filter ({_FILE.replace('target', 't')}) as file_targets, bool_or({_FILE.replace('target', 't')}) as has_file_target,
      bool_or(contains(lower(rel_type), 'attachedtemplate')) as has_external_template, count(distinct t) filter (regexp_matches(t, '(?i)^https?://')) as url_count from e group by 1""",
)
def external_rels(x: Inputs) -> DataFrame:
    return office.external_rels(x.sql(_BIG_RELS))


@query(
    "office_external_targets", "O-8",
    f"""select doc_id, trim(target) as target, {_FILE.replace('target', 'trim(target)')} as is_file, regexp_matches(trim(target), '(?i)^https?://') as is_url
    from ({_BIG_RELS}) where lower(target_mode) = 'external'""",
)
def external_targets(x: Inputs) -> DataFrame:
    return office.external_targets(x.sql(_BIG_RELS)).select("doc_id", "target", "is_file", "is_url")


# Whole documents as body text of two packages, one above the text limit.
_BODY = "select case when doc_id % 10 = 0 then 1 else 0 end as doc_id, 'word/document.xml' as part, doc_id as seq, text, false as vanish, '000000' as color, 20 as half_points, false as deleted from {documents}"


@query(
    "office_text_stats", "O-9",
    f"select doc_id, cast(sum(length(text)) as bigint) as text_length, sum(length(text)) > {P.DOCX_MAX_TEXT} as text_limit_reached from ({_BODY}) group by doc_id",
)
def text_stats(x: Inputs) -> DataFrame:
    return office.text_stats(x.sql(_BODY))


_REASONS = [
    ("deleted", "deleted-or-field-instruction-text"), ("half_points between 1 and 8", "very-small-font"),
    (f"upper(color) in {in_list(P.DOCX_WHITE)}", "white-or-near-white-font"), ("vanish", "word-hidden-text-property"),
    (hit("text", _ZW, ""), "zero-width-characters"),
]
_LOW = f"lower({squeeze('text')})"
_SIGNALS = [
    (any_hit(_LOW, P.COMMAND_DOCX, "is"), "command-or-script-indicator"), (hit("text", P.URL_DOCX), "contains-url"),
    (any_hit(_LOW, P.CREDENTIAL_DOCX, "is"), "credential-theft-language"), (any_hit(_LOW, P.INJECT_DOCX, "is"), "prompt-injection-like-instruction"),
    (hit("text", _ZW, ""), "zero-width-characters"),
]
RUNS = f"""with seen as (select *, case when regexp_matches(text, '\\S') then {names(_REASONS)} else '' end as reasons, {names(_SIGNALS)} as signals from {{fx_ooxml_runs}})
"""
_BIG_RUNS = "(select doc_id % 40 as doc_id, part, doc_id * 8 + seq as seq, text, vanish, color, half_points, deleted, revision from {fx_ooxml_runs})"


@query(
    "office_hidden_runs", "O-10",
    RUNS.replace("{fx_ooxml_runs}", _BIG_RUNS) + "select doc_id, seq, reasons, signals from seen where reasons <> ''",
)
def hidden_runs(x: Inputs) -> DataFrame:
    out = office.hidden_runs(office.inspect_runs(x.sql("select * from " + _BIG_RUNS)))
    return out.select("doc_id", "seq", F.array_join("reasons", ",").alias("reasons"), F.array_join("signals", ",").alias("signals"))


_RUN_FLAGS = [
    (f"bool_or(regexp_matches(signals, '{n}'))", n)
    for n in ("command-or-script-indicator", "credential-theft-language", "prompt-injection-like-instruction")
] + [("bool_or(reasons <> '' and signals <> '')", "suspicious-content-in-hidden-text"), ("bool_or(regexp_matches(signals, 'zero-width'))", "zero-width-characters")]


@query("office_indicators", "O-11", RUNS + f"select doc_id, {names(_RUN_FLAGS)} as content_indicators from seen group by doc_id")
def indicators(x: Inputs) -> DataFrame:
    return office.indicators(x.fx_ooxml_runs).select("doc_id", F.array_join("content_indicators", ",").alias("content_indicators"))


_COMMENT = "bool_or(lower(name) like '%comments%' and lower(name) like '%.xml')"


@query(
    "office_flags", "O-12",
    f"""with c as (select doc_id, {_COMMENT} as has_comments from {{fx_ooxml_entries}} group by 1), t as (select doc_id, bool_or(revision) as d from {{fx_ooxml_runs}} group by 1)
    select c.doc_id, has_comments, coalesce(d, false) as has_tracked_changes from c left join t on t.doc_id = c.doc_id""",
)
def flags(x: Inputs) -> DataFrame:
    return office.flags(x.fx_ooxml_runs, x.fx_ooxml_entries)


_E = lambda i: f"bool_or({_WARN[i][0]})"
FACTS = RUNS.rstrip() + f""", e as (select doc_id, count(*) as entry_count, sum(size) as uncompressed_size, {_limit()} as error,
    {names([(_E(i), w) for i, (_, w) in enumerate(_WARN)])} as warnings, bool_or({_EXE}) as exe_entry, {_COMMENT} as has_comments,
    count(distinct case when contains(lower(name), 'vbaproject.bin') then name end) as macros, count(*) filter ({_EMB}) as embedded, bool_or({_EMB} and {_EXE}) as emb_exe
  from {{fx_ooxml_full}} group by 1),
r as (select doc_id, count(*) filter ({_FILE}) as file_targets, bool_or(contains(lower(rel_type), 'attachedtemplate')) as template,
    count(distinct case when regexp_matches(target, '(?i)^https?://') then target end) as urls from {{fx_ooxml_rels}} where lower(target_mode) = 'external' group by 1),
pw as (select doc_id, {names(_PART_WARN)} as part_warnings from (select doc_id, count(*) as xml_parts, bool_or(size > {P.DOCX_ENTRY_LIMIT}) as big,
    bool_or(size <= {P.DOCX_ENTRY_LIMIT} and broken) as bad from {{fx_xml_parts}} group by 1)),
t as (select doc_id, sum(length(text)) as text_length, count(*) filter (reasons <> '') as hidden_count, bool_or(revision) as tracked, {names(_RUN_FLAGS)} as ind,
    coalesce(bool_or(regexp_matches(signals, '{"|".join(P.DOCX_HIDDEN_SIGNALS)}')) filter (reasons <> ''), false) as hidden_suspicious from seen group by 1),
facts as (select e.doc_id, error is null as supported, error, case when error is null then array_to_string(list_sort(list_filter(list_concat(string_split(warnings, ','), string_split(coalesce(part_warnings, ''), ',')), lambda w: w <> '')), ',') else error end as warnings,
    case when error is null then coalesce(text_length, 0) else 0 end as text_length, case when error is null then coalesce(hidden_count, 0) else 0 end as hidden_count,
    error is null and coalesce(hidden_suspicious, false) as hidden_suspicious, case when error is null then coalesce(urls, 0) else 0 end as urls,
    case when error is null then coalesce(file_targets, 0) else 0 end as file_targets, case when error is null then macros else 0 end as macros,
    case when error is null then embedded else 0 end as embedded, error is null and coalesce(emb_exe, false) as emb_exe, error is null and coalesce(template, false) as has_external_template,
    error is null and has_comments as has_comments, error is null and coalesce(tracked, false) as has_tracked_changes,
    case when error is null then array_to_string(list_sort(list_filter(list_concat(string_split(coalesce(ind, ''), ','), [case when exe_entry then 'executable-or-script-like-package-entry' end,
      case when macros > 0 then 'macro-related-component-detected' end, case when embedded > 0 then 'embedded-objects-present' end,
      case when coalesce(file_targets, 0) > 0 then 'external-file-or-network-path' end]), lambda i: i is not null and i <> '')), ',') else '' end as indicators
  from e left join r on r.doc_id = e.doc_id left join t on t.doc_id = e.doc_id left join pw on pw.doc_id = e.doc_id)
"""


def _facts(x: Inputs) -> DataFrame:
    return office.facts(x.fx_ooxml_full, x.fx_ooxml_runs, x.fx_ooxml_rels, x.fx_xml_parts)


@query(
    "office_facts", "O-13",
    FACTS + "select doc_id, supported, error, warnings, cast(text_length as bigint) as text_length, hidden_count, hidden_suspicious, urls, file_targets, macros, embedded, "
    "has_external_template, has_comments, has_tracked_changes, coalesce(indicators, '') as indicators from facts",
)
def facts(x: Inputs) -> DataFrame:
    return _facts(x).select(
        "doc_id", "supported", "error", F.array_join("warnings", ",").alias("warnings"), "text_length", "hidden_count", "hidden_suspicious", F.col("url_count").alias("urls"),
        "file_targets", F.col("macro_count").alias("macros"), F.col("embedded_count").alias("embedded"), "has_external_template", "has_comments", "has_tracked_changes",
        F.array_join("indicators", ",").alias("indicators"),
    )


_SEVERE = f"regexp_matches(warnings, '{'|'.join(P.DOCX_SEVERE_WARNINGS)}')"
_RULES = {
    "OD-1": ("not supported", "'high'", "20"), "OD-2": ("supported and warnings <> ''", f"case when {_SEVERE} then 'high' else 'medium' end", f"case when {_SEVERE} then 18 else 7 end"),
    "OD-3": ("supported and hidden_count > 0", "case when hidden_suspicious then 'high' else 'medium' end", "case when hidden_suspicious then 22 else 8 end"),
    "OD-4": ("supported and urls > 0", "'low'", "2"), "OD-5": ("supported and file_targets > 0", "'high'", "18"), "OD-6": ("has_external_template", "'medium'", "8"),
    "OD-7": ("supported and embedded > 0", "case when emb_exe then 'high' else 'medium' end", "case when emb_exe then 25 else 6 end"), "OD-8": ("supported and macros > 0", "'high'", "20"),
    "OD-9": (f"supported and regexp_matches(indicators, '{'|'.join(P.DOCX_REPORTED_INDICATORS)}')", "'high'", "15"), "OD-10": ("has_tracked_changes", "'low'", "1"),
    "OD-11": ("has_comments", "'low'", "1"), "OD-12": ("supported and text_length = 0", "'medium'", "5"),
}
# Category and source by rule, written out again for the check.
_ORIGIN = {
    "OD-1": ("docx-analysis", "docx-static-analysis"), "OD-2": ("docx-package", "docx-package-analysis"), "OD-3": ("docx-hidden-content", "docx-hidden-text-analysis"),
    "OD-4": ("docx-links", "docx-relationship-analysis"), "OD-5": ("docx-external-content", "docx-relationship-analysis"),
    "OD-6": ("docx-external-content", "docx-relationship-analysis"), "OD-7": ("docx-embedded-content", "docx-embedded-object-analysis"),
    "OD-8": ("docx-macros", "docx-package-analysis"), "OD-9": ("docx-content-indicators", "docx-content-analysis"),
    "OD-10": ("docx-document-structure", "docx-xml-analysis"), "OD-11": ("docx-document-structure", "docx-xml-analysis"), "OD-12": ("docx-content", "docx-xml-analysis"),
}
EVIDENCE = ", ev as (" + " union all ".join(
    f"select doc_id, '{r}' as rule_id, '{_ORIGIN[r][0]}' as category, '{_ORIGIN[r][1]}' as source, {sev} as severity, {score} as score from facts where {when}"
    for r, (when, sev, score) in _RULES.items()
) + ") "


@query("office_evidence", "OD-1, OD-2, OD-3, OD-4, OD-5, OD-6, OD-7, OD-8, OD-9, OD-10, OD-11, OD-12, EV-1, EV-2", FACTS + EVIDENCE + "select doc_id, rule_id, category, source, severity, score from ev")
def office_evidence(x: Inputs) -> DataFrame:
    return evidence.apply_rules(_facts(x), evidence.DOCX, "doc_id").select("doc_id", "rule_id", "category", "source", "severity", "score")


@query(
    "office_unsupported", "OD-1, V-6",
    f"with e as (select doc_id, {_limit()} as error from {{fx_ooxml_entries}} group by 1) select doc_id, 'OD-1' as rule_id, error as description from e where error is not null",
)
def unsupported(x: Inputs) -> DataFrame:
    """Packages that lack required parts or break a limit give exactly one finding."""
    rows = evidence.apply_rules(office.facts(x.fx_ooxml_entries, x.fx_ooxml_runs, x.fx_ooxml_rels), evidence.DOCX, "doc_id")
    return rows.where(F.col("rule_id") == "OD-1").select("doc_id", "rule_id", "description")


AV = "case when doc_id % 9 = 0 then 'threat' when doc_id % 4 = 0 then 'error' else 'clean' end"


@query(
    "office_verdict", "V-6",
    FACTS + EVIDENCE + f""", rs as (select doc_id, least(sum(score), 100) as score, bool_or(severity in ('high', 'critical')) as high from ev group by 1)
    select f.doc_id, case when {AV.replace('doc_id', 'f.doc_id')} = 'threat' then 'block'
      when {AV.replace('doc_id', 'f.doc_id')} <> 'clean' or not supported or f.doc_id % 10 = 0 or coalesce(high, false) or warnings <> '' or hidden_count > 0 or embedded > 0
        or macros > 0 or has_external_template or coalesce(indicators, '') <> '' or coalesce(score, 0) >= 15 then 'review' else 'allow' end as verdict
    from facts f left join rs on rs.doc_id = f.doc_id""",
)
def verdict(x: Inputs) -> DataFrame:
    frame = _facts(x)
    scored = evidence.with_evidence(frame, evidence.DOCX).withColumn("f", F.struct(*[c for c in frame.columns if c != "doc_id"]))
    return scored.select(
        "doc_id",
        scoring.docx_verdict(F.expr(AV), scoring.docx_review_indicators("f"), F.col("doc_id") % 10 == 0, F.col("evidence"), scoring.array_score(F.col("evidence"))).alias("verdict"),
    )


