"""Queries on executables and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import hit, in_list, names, query, text
from docrisk.catalog.signal_queries import _IPS
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import binary, evidence, scoring



@query(
    "exe_strings", "B-1",
    f"""with s as (select doc_id, list_distinct_keep as strings from (
      select doc_id, list_transform(list_filter(list_zip(c, range(1, len(c) + 1)), lambda p: list_position(c, p[1]) = p[2]), lambda p: p[1]) as list_distinct_keep from (
        select doc_id, list_filter(list_transform(regexp_extract_all(text, '[\\x20-\\x7e]{{{{5,}}}}'), lambda v: trim(v)), lambda v: v <> '') as c from {{fx_seeded}})))
    select doc_id, len(strings) as string_count, sha256(array_to_string(strings, chr(10))) as strings_sha from s""",
)
def strings(x: Inputs) -> DataFrame:
    raw = x.fx_seeded.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return binary.strings(raw).select("doc_id", F.size("strings").cast("bigint").alias("string_count"), F.sha2(F.array_join("strings", "\n"), 256).alias("strings_sha"))


@query(
    "exe_wide_strings", "B-1",
    """select conv_id, turn, trim(role) as wide from {conversations} where length(trim(role)) >= 5""",
)
def wide_strings(x: Inputs) -> DataFrame:
    """UTF-16LE runs between zero bytes: the role of every turn."""
    raw = x.conversations.select(
        "conv_id", "turn", F.expr("unhex(concat('0001', hex(encode(trim(role), 'UTF-16LE')), '0001'))").alias("content")
    )
    return binary.strings(raw).where(F.size("strings") > 0).select("conv_id", "turn", F.array_join("strings", "|").alias("wide"))


@query(
    "exe_entropy", "B-2",
    """with h as (select doc_id, hex(encode(text)) as h from {documents}),
    b as (select doc_id, h[i:i+1] as byte, count(*) as n from h, unnest(range(1, length(h), 2)) as u(i) group by 1, 2),
    t as (select doc_id, n, sum(n) over (partition by doc_id) as total from b)
    select doc_id, round(-sum(n / total * log2(n / total)), 3) + 0.0 as entropy from t group by doc_id""",
)
def entropy(x: Inputs) -> DataFrame:
    raw = x.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return binary.entropy(raw).select("doc_id", "entropy")


@query("exe_high_entropy", "B-3", f"select file_id, idx, name from {{fx_pe_sections}} where entropy >= {P.EXE_ENTROPY} and raw_size >= {P.EXE_ENTROPY_SIZE}")
def high_entropy(x: Inputs) -> DataFrame:
    return binary.high_entropy(x.fx_pe_sections).select("file_id", "idx", "name")


_BIT = lambda m: f"(characteristics & {m}) <> 0"
_X, _R, _W = _BIT(binary.EXECUTE), _BIT(binary.READ), _BIT(binary.WRITE)


@query("exe_section_flags", "B-4", f"select file_id, idx, {_X} as executable, {_R} as readable, {_W} as writable from {{fx_pe_sections}}")
def section_flags(x: Inputs) -> DataFrame:
    return binary.section_flags(x.fx_pe_sections).select("file_id", "idx", "executable", "readable", "writable")


_OVERLAPS = """select file_id, bool_or(raw_ptr < reach) as overlapping from (
  select file_id, raw_ptr, coalesce(max(raw_ptr + raw_size) over (partition by file_id order by raw_ptr, raw_size rows between unbounded preceding and 1 preceding), 0) as reach
  from {fx_pe_sections} where raw_size > 0) group by file_id"""


@query("exe_overlaps", "B-5", _OVERLAPS)
def overlaps(x: Inputs) -> DataFrame:
    return binary.overlaps(binary.pack_sections(x.fx_pe_sections)).select("file_id", "overlapping")


def _with_headers(x: Inputs) -> DataFrame:
    return x.fx_pe_headers.join(binary.pack_sections(x.fx_pe_sections), "file_id")


@query(
    "exe_raw_ranges", "B-5",
    "select h.file_id, bool_and(raw_size = 0 or raw_ptr + raw_size <= file_size) as raw_ranges_valid from {fx_pe_headers} h join {fx_pe_sections} s on s.file_id = h.file_id group by 1",
)
def raw_ranges(x: Inputs) -> DataFrame:
    return binary.raw_ranges_valid(_with_headers(x)).select("file_id", "raw_ranges_valid")


_OUTSIDE = f"""select h.file_id, any_value(entry_point) <> 0 and not coalesce(bool_or({_X} and entry_point >= va and entry_point < va + greatest(vsize, raw_size)), false) as entry_outside
 from {{fx_pe_headers}} h join {{fx_pe_sections}} s on s.file_id = h.file_id group by 1"""


@query("exe_entry_point", "B-6", _OUTSIDE)
def entry_point(x: Inputs) -> DataFrame:
    return binary.entry_point(_with_headers(x)).select("file_id", "entry_outside")


@query(
    "exe_rva_to_offset", "B-7",
    """with m as (select h.file_id, h.file_size, h.entry_point as rva, s.* exclude (file_id), row_number() over (partition by h.file_id order by idx) as rn
      from {fx_pe_headers} h join {fx_pe_sections} s on s.file_id = h.file_id
      where h.entry_point >= va and h.entry_point < va + least(case when vsize > 0 then vsize else raw_size end, raw_size)),
    d as (select distinct h.file_id from {fx_pe_headers} h join {fx_pe_sections} s on s.file_id = h.file_id)
    select d.file_id, case when m.file_id is null then case when h.entry_point < least(h.header_end, h.file_size) then cast(h.entry_point as bigint) end
      when raw_ptr <= m.file_size and rva - va + raw_ptr < m.file_size then cast(rva - va + raw_ptr as bigint) end as file_offset
    from d join {fx_pe_headers} h on h.file_id = d.file_id left join m on m.file_id = d.file_id and rn = 1""",
)
def rva_to_offset(x: Inputs) -> DataFrame:
    return binary.rva_to_offset(_with_headers(x), "entry_point", header_end="header_end").select("file_id", "file_offset")


@query("exe_sensitive_imports", "B-8", f"select file_id, seq, dll, function from {{fx_pe_imports}} where lower(function) in {in_list(P.SENSITIVE_APIS)}")
def sensitive_imports(x: Inputs) -> DataFrame:
    return binary.sensitive_imports(x.fx_pe_imports)


_BEHAVE = names([(hit("text", p), n) for n, p in P.BEHAVIOURS.items()])
_EXE_URLS = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {text('(?i)' + P.URL_EXE)}), lambda u: rtrim(u, {text(P.URL_EXE_TAIL)}))))"


@query("exe_behaviours", "B-9, T-12, T-14", f"select doc_id, {_BEHAVE} as indicators, array_to_string({_EXE_URLS}, ' ') as urls from {{fx_seeded}}")
def behaviours(x: Inputs) -> DataFrame:
    held = x.fx_seeded.select("doc_id", F.array("text").alias("strings"))
    return binary.behaviours(held).select("doc_id", F.array_join("indicators", ",").alias("indicators"), F.array_join("urls", " ").alias("urls"))


_OVERLAY = """select h.file_id, cast(greatest(0, any_value(file_size) - least(greatest(max(raw_ptr + raw_size), any_value(header_end)), any_value(file_size))) as bigint) as overlay_size
 from {fx_pe_headers} h join {fx_pe_sections} s on s.file_id = h.file_id group by 1"""


@query("exe_overlay", "B-10", _OVERLAY)
def overlay(x: Inputs) -> DataFrame:
    return binary.overlay(_with_headers(x), header_end="header_end").select("file_id", "overlay_size")


_CERT = "cert_offset > 0 and cert_size > 0 and cert_offset + cert_size <= file_size"


@query("exe_certificate", "B-11", f"select file_id, {_CERT} as has_certificate from {{fx_pe_headers}}")
def certificate(x: Inputs) -> DataFrame:
    return binary.certificate(x.fx_pe_headers).select("file_id", "has_certificate")


_ARCH = "case when magic = 267 then 'x86' when magic = 523 and machine = 43620 then 'arm64' when magic = 523 then 'x64' end"
_ERR = f"case when {_ARCH} is null then 'unsupported optional header' when not (({_ARCH} = 'x86' and machine = 332) or ({_ARCH} = 'x64' and machine in (34404, 512)) or ({_ARCH} = 'arm64' and machine = 43620)) then 'machine conflicts with optional header' end"


@query("exe_header_status", "B-12", f"select file_id, {_ARCH} as architecture, {_ERR} as header_error from {{fx_pe_headers}}")
def header_status(x: Inputs) -> DataFrame:
    return binary.header_status(x.fx_pe_headers).select("file_id", "architecture", "header_error")


_BIG = "select file_id % 20 as file_id, file_id * 8 + seq as seq, dll, concat(function, cast(file_id % 9 as string)) as function from {fx_pe_imports}"


@query(
    "exe_imports", "B-13",
    f"select file_id, dll, count(*) as functions, count(distinct function) as distinct_functions from ({_BIG}) group by 1, 2",
)
def imports(x: Inputs) -> DataFrame:
    return binary.imports(x.sql(_BIG))


FACTS = f"""with s as (select file_id, count(*) as section_count, max(raw_ptr + raw_size) as last_end, count(*) filter (entropy >= {P.EXE_ENTROPY} and raw_size >= {P.EXE_ENTROPY_SIZE}) as packed,
    count(*) filter ({_X} and {_W}) as wx from {{fx_pe_sections}} group by 1),
ov as ({_OVERLAPS}), rr as (select h.file_id, bool_and(raw_size = 0 or raw_ptr + raw_size <= file_size) as fits from {{fx_pe_headers}} h join {{fx_pe_sections}} s on s.file_id = h.file_id group by 1),
ep as ({_OUTSIDE}),
ic as (select file_id, count(*) as imports from {{fx_pe_imports}} group by 1),
im as (select file_id, count(*) as n, string_agg(distinct lower(function), ',' order by lower(function)) as api, bool_or(lower(function) in {in_list(P.INJECTION_APIS)}) as inject from {{fx_pe_imports}} where lower(function) in {in_list(P.SENSITIVE_APIS)} group by 1),
st as (select doc_id as file_id, {_BEHAVE} as indicators, len({_EXE_URLS}) + len({_IPS}) as urls from {{fx_seeded}}),
raw as (select h.file_id, h.entry_point, case when coalesce(section_count, 0) not between 1 and {P.EXE_MAX_SECTIONS} then 'malformed header' else {_ERR} end as error, {_CERT} as cert, coalesce(section_count, 0) as section_count, coalesce(packed, 0) as packed, coalesce(wx, 0) as wx,
    greatest(0, file_size - least(greatest(coalesce(last_end, 0), header_end), file_size)) as overlay_size, machine, subsystem, image_base, coalesce(imports, 0) as imports, coalesce(api, '') as api, coalesce(im.n, 0) as n, coalesce(inject, false) as inject, coalesce(indicators, '') as indicators, coalesce(urls, 0) as urls,
    {names([("coalesce(entry_outside, h.entry_point <> 0)", "entry-point-not-in-executable-section"), ("overlapping", "overlapping-section-raw-ranges"), ("not fits", "section-raw-range-out-of-bounds")])} as warnings
  from {{fx_pe_headers}} h left join s on s.file_id = h.file_id left join ov on ov.file_id = h.file_id left join rr on rr.file_id = h.file_id left join ep on ep.file_id = h.file_id
  left join im on im.file_id = h.file_id left join ic on ic.file_id = h.file_id left join st on st.file_id = h.file_id),
facts as (select file_id, entry_point, error is null as supported, error, if(error is null, section_count, 0) as section_count, if(error is null, warnings, '') as warnings, if(error is null, n, 0) as n, machine, subsystem, image_base, if(error is null, imports, 0) as imports, if(error is null, api, '') as api,
  error is null and inject as inject, if(error is null, indicators, '') as indicators, if(error is null, urls, 0) as urls, if(error is null, packed, 0) as packed, if(error is null, wx, 0) as wx,
  error is null and cert as has_certificate, cast(if(error is null, overlay_size, 0) as bigint) as overlay_size from raw)
"""


def _facts(x: Inputs) -> DataFrame:
    held = x.fx_seeded.select(F.col("doc_id").alias("file_id"), F.array("text").alias("strings"))
    return binary.facts(x.fx_pe_headers, x.fx_pe_sections, x.fx_pe_imports, binary.behaviours(held).drop("strings"))


@query(
    "exe_facts", "B-14",
    FACTS + "select file_id, supported, error, cast(section_count as bigint) as section_count, warnings, n as sensitive_imports, inject, indicators, packed, wx, has_certificate, overlay_size, machine, subsystem, image_base, imports, api from facts",
)
def facts(x: Inputs) -> DataFrame:
    return _facts(x).select(
        "file_id", "supported", "error", F.col("section_count").cast("bigint").alias("section_count"), F.array_join("structural_warnings", ",").alias("warnings"),
        F.col("sensitive_import_count").alias("sensitive_imports"), F.col("has_injection_import").alias("inject"), F.array_join("indicators", ",").alias("indicators"),
        F.size("high_entropy_sections").cast("bigint").alias("packed"), F.size("writable_executable_sections").cast("bigint").alias("wx"), "has_certificate",
        F.col("overlay_size").cast("bigint").alias("overlay_size"), "machine", "subsystem", "image_base", F.col("import_count").alias("imports"),
        F.array_join("sensitive_imports", ",").alias("api"),
    )


_INJ = "contains(indicators, 'process-injection-api')"
_RULES = {
    "X-1": ("not supported", "'high'", "18"), "X-2": ("supported and warnings <> ''", "'high'", "18"),
    "X-3": ("supported and n > 0", "case when inject then 'high' else 'medium' end", "case when n >= 3 then 18 else 10 end"),
    "X-4": ("supported and indicators <> ''", f"case when {_INJ} then 'high' else 'medium' end", f"case when {_INJ} then 15 else 8 end"),
    "X-5": ("supported and urls > 0", "'low'", "3"), "X-6": ("supported and packed > 0", "'medium'", "8"), "X-7": ("supported and wx > 0", "'medium'", "8"),
    "X-8": ("supported and not has_certificate", "'low'", "2"), "X-9": ("supported and overlay_size > 1024", "'low'", "3"),
    "X-10": ("supported and (section_count = 0 or entry_point = 0)", "'high'", "15"),
}
# Category and source by rule, written out again for the check.
_ORIGIN = {
    "X-1": ("exe-structure", "exe-static-analysis"), "X-2": ("exe-structure", "exe-structure-validation"), "X-3": ("exe-imports", "exe-import-analysis"),
    "X-4": ("exe-strings", "exe-string-analysis"), "X-5": ("exe-network", "exe-string-analysis"), "X-6": ("exe-packing", "exe-section-analysis"),
    "X-7": ("exe-sections", "exe-section-analysis"), "X-8": ("exe-signature", "exe-signature-presence-check"), "X-9": ("exe-overlay", "exe-structure-analysis"),
    "X-10": ("exe-structure", "exe-structure-analysis"),
}
EVIDENCE = ", ev as (" + " union all ".join(
    f"select file_id, '{r}' as rule_id, '{_ORIGIN[r][0]}' as category, '{_ORIGIN[r][1]}' as source, {sev} as severity, {score} as score from facts where {when}" for r, (when, sev, score) in _RULES.items()
) + ") "


@query("exe_evidence", "X-1, X-2, X-3, X-4, X-5, X-6, X-7, X-8, X-9, X-10, EV-1, EV-2", FACTS + EVIDENCE + "select file_id, rule_id, category, source, severity, score from ev")
def exe_evidence(x: Inputs) -> DataFrame:
    return evidence.apply_rules(_facts(x), evidence.EXE, "file_id").select("file_id", "rule_id", "category", "source", "severity", "score")


AV = "case when file_id % 9 = 0 then 'threat' when file_id % 4 = 0 then 'error' else 'clean' end"


@query(
    "exe_verdict", "V-5",
    FACTS + EVIDENCE + f""", rs as (select file_id, least(sum(score), 100) as score, bool_or(severity = 'high') as high from ev group by 1)
    select f.file_id, case when {AV.replace('file_id', 'f.file_id')} = 'threat' then 'block'
      when {AV.replace('file_id', 'f.file_id')} <> 'clean' or not supported or f.file_id % 10 = 0 or warnings <> '' or coalesce(high, false) or coalesce(score, 0) >= 25 then 'review' else 'allow' end as verdict
    from facts f left join rs on rs.file_id = f.file_id""",
)
def verdict(x: Inputs) -> DataFrame:
    scored = evidence.with_evidence(_facts(x), evidence.EXE)
    return scored.select(
        "file_id",
        scoring.exe_verdict(F.expr(AV), F.col("supported"), F.col("file_id") % 10 == 0, F.col("structural_warnings"), F.col("evidence"), scoring.array_score(F.col("evidence"))).alias("verdict"),
    )
