"""Queries on text signals. Inputs are whole documents with one seeded phrase each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import any_hit, hit, names, query, squeeze, text
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.functions import signals as S

_FLAT = f"lower({squeeze('text')})"
_ZW = f"[{P.ZERO_WIDTH}]"


def _listed(x: Inputs, family: str) -> DataFrame:
    return S.with_signals(x.fx_seeded, "text", family).select("doc_id", F.array_join("signals", ",").alias("signals"))


def _family(name: str, covers: str, family: str, check: str) -> None:
    query(name, covers, f"select doc_id, {check} as signals from {{fx_seeded}}")(lambda x: _listed(x, family))


def _kinds(family: dict[str, str], flags: str) -> str:
    return names([(hit("text", family[n], flags), n) for n in sorted(family)])


_family("sig_injection_json", "T-1", "inject_json", _kinds(P.INJECT_JSON, "i"))
_family("sig_injection_docx", "T-2", "inject_docx", names([(any_hit(_FLAT, P.INJECT_DOCX, "is"), "prompt-injection-like-instruction")]))
_family("sig_injection_pdf", "T-3", "inject_pdf", names([(any_hit(squeeze("text"), P.INJECT_PDF), "prompt-injection")]))
_family("sig_command_docx", "T-4", "command_docx", names([(any_hit(_FLAT, P.COMMAND_DOCX, "is"), "command-or-script-indicator")]))
_family("sig_command_pdf", "T-4", "command_pdf", names([(any_hit(squeeze("text"), P.COMMAND_PDF), "command-execution")]))
_family("sig_executable_json", "T-5", "exec_json", _kinds(P.EXEC_JSON, "i"))
_family("sig_credential_docx", "T-6", "credential_docx", names([(any_hit(_FLAT, P.CREDENTIAL_DOCX, "is"), "credential-theft-language")]))
_family("sig_credential_pdf", "T-6", "credential_pdf", names([(any_hit(squeeze("text"), P.CREDENTIAL_PDF), "credential-request")]))
_family("sig_obfuscation", "T-7", "obfuscation", names([(any_hit(squeeze("text"), P.OBFUSCATION_PDF), "possible-obfuscation")]))
_family("sig_secrets", "T-8", "secret", _kinds(P.SECRETS, ""))
_family("sig_html_like", "T-9", "html", names([(hit("text", P.HTML_LIKE, "is"), "html-or-script-like")]))


@query(
    "sig_html_count", "T-9",
    f"""select conv_id, count(*) filter ({hit("concat(text, case when turn % 3 = 0 then ' <script>x</script>' else '' end)", P.HTML_LIKE, "is")}) as html_like
    from {{conversations}} group by conv_id""",
)
def html_count(x: Inputs) -> DataFrame:
    """Script-like strings per conversation, every third turn seeded."""
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit(" <script>x</script>")).otherwise(F.lit("")))
    return x.conversations.groupBy("conv_id").agg(F.count_if(S.html_like(said)).alias("html_like"))


@query(
    "sig_zero_width", "T-10",
    f"""select doc_id, coalesce(array_to_string(list_distinct(regexp_extract_all(text, '{_ZW}')), '|'), '') as zero_width,
    regexp_matches(text, '{_ZW}') as has_zero_width from {{fx_seeded}}""",
)
def zero_width(x: Inputs) -> DataFrame:
    found = S.zero_width_chars(F.col("text"))
    return x.fx_seeded.select("doc_id", F.array_join(found, "|").alias("zero_width"), S.has_zero_width(F.col("text")).alias("has_zero_width"))


_TAGGED = "concat(text, case when doc_id % 4 = 0 then '{tag}' else '' end)".replace("{tag}", "\U000e0041\U000e0042")


@query(
    "sig_invisible", "T-11",
    f"""with t as (select doc_id, {_TAGGED} as text from {{fx_seeded}})
    select doc_id, regexp_matches(text, '[\\x{{{{E0000}}}}-\\x{{{{E007F}}}}]') as has_tags,
      sha256(regexp_replace(replace(replace(replace(replace(replace(text, '​', '[ZWSP]'), '‌', '[ZWNJ]'), '‍', '[ZWJ]'),
        '⁠', '[WJ]'), '﻿', '[BOM]'), '[\\x{{{{E0000}}}}-\\x{{{{E007F}}}}]', '[TAG]', 'g')) as visible_sha from t""",
)
def invisible(x: Inputs) -> DataFrame:
    tagged = x.fx_seeded.select("doc_id", F.expr(_TAGGED).alias("text"))
    return tagged.select("doc_id", S.invisible(F.col("text")).alias("v")).select(
        "doc_id", "v.has_tags", F.sha2("v.visible", 256).alias("visible_sha")
    )


_URL_LISTS = {
    "json": f"list_distinct(list_filter(list_transform(regexp_extract_all(text, {text('(?i)' + P.URL_JSON)}), lambda u: rtrim(u[1:300], {text(P.URL_JSON_TAIL)})), lambda u: u <> ''))",
    "exe": f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {text('(?i)' + P.URL_EXE)}), lambda u: rtrim(u, {text(P.URL_EXE_TAIL)}))))",
    "pdf": f"list_sort(list_distinct(regexp_extract_all(text, {text('(?i)' + P.URL_PDF)})))",
    "docx": f"regexp_extract_all(text, {text('(?i)' + P.URL_DOCX)})",
}


@query(
    "sig_urls", "T-12",
    "select item_id, src, "
    + ", ".join(f"array_to_string(list_sort({e}), ' ') as urls_{v}" for v, e in _URL_LISTS.items())
    + " from (select src, item_id, text from {fx_texts} union all select 'seeded', doc_id, text from {fx_seeded})",
)
def urls(x: Inputs) -> DataFrame:
    rows = x.fx_texts.select("src", "item_id", "text").unionByName(x.fx_seeded.select(F.lit("seeded").alias("src"), F.col("doc_id").alias("item_id"), "text"))
    return rows.select(
        "item_id", "src", *[F.array_join(F.array_sort(S.urls(F.col("text"), v)), " ").alias(f"urls_{v}") for v in _URL_LISTS]
    )


_REDACT = (
    r"regexp_replace(regexp_replace({u}, '(?i)(https?://)[^/@\s]+@', '\1[redacted]@'), '[?#].*$',"
    r" case when contains({u}, '?') then '?[redacted]' else '#[redacted]' end)"
)
_PAGE_URL = "concat(replace(url, '://', case when page_id % 3 = 0 then '://me:pw@' else '://' end), case page_id % 4 when 0 then '?token=1#a' when 1 then '#frag' else '' end)"


@query("sig_redact_url", "T-13", f"with u as (select page_id, {_PAGE_URL} as u from {{pages}}) select page_id, " + _REDACT.replace("{u}", "u") + " as url from u")
def redact_url(x: Inputs) -> DataFrame:
    return x.pages.select("page_id", S.redact_url(F.expr(_PAGE_URL)).alias("url"))


_IPS = (
    f"list_distinct(list_filter(regexp_extract_all(text, {text(P.IPV4)}), lambda a: list_max(list_transform(string_split(a, '.'), lambda p: cast(p as int))) <= 255))"
)


@query(
    "sig_ipv4", "T-14",
    f"select doc_id, array_to_string(list_sort({_IPS}), ' ') as addresses from {{fx_seeded}}",
)
def ipv4(x: Inputs) -> DataFrame:
    t = F.col("text")
    return x.fx_seeded.select(
        "doc_id", F.array_join(F.array_sort(S.ipv4(t)), " ").alias("addresses"),
    )


_PDF_SIGNAL_PAIRS = [
    (any_hit(squeeze("text"), P.COMMAND_PDF), "command-execution"),
    (hit("text", P.URL_PDF), "contains-url"),
    (any_hit(squeeze("text"), P.CREDENTIAL_PDF), "credential-request"),
    (any_hit(squeeze("text"), P.OBFUSCATION_PDF), "possible-obfuscation"),
    (any_hit(squeeze("text"), P.INJECT_PDF), "prompt-injection"),
    (hit("text", _ZW, ""), "zero-width-characters"),
]
_BY_NAME = {n: c for c, n in _PDF_SIGNAL_PAIRS}


@query(
    "sig_risk_hints", "T-15",
    f"select doc_id, {names(_PDF_SIGNAL_PAIRS)} as signals, {names([(_BY_NAME[s], level) for s, level in S.HINTS])} as hints from {{fx_seeded}}",
)
def risk_hints(x: Inputs) -> DataFrame:
    found = x.fx_seeded.withColumn("s", S.pdf_signals(F.col("text")))
    return found.select("doc_id", F.array_join("s", ",").alias("signals"), F.array_join(S.risk_hints(F.col("s")), ",").alias("hints"))


_COMPARE = f"trim(regexp_replace(regexp_replace(lower(text), '{_ZW}', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "sig_tokens", "T-16",
    f"""select doc_id, sha256({_COMPARE}) as compare_sha, cast(len(list_filter(string_split({_COMPARE}, ' '), lambda t: t <> '')) as bigint) as tokens
    from {{fx_seeded}}""",
)
def tokens(x: Inputs) -> DataFrame:
    t = F.col("text")
    return x.fx_seeded.select(
        "doc_id", F.sha2(S.compare_form(t), 256).alias("compare_sha"), F.size(S.tokens(t)).cast("bigint").alias("tokens")
    )


def _token_set(col: str) -> str:
    form = _COMPARE.replace("text", col)
    return f"list_distinct(list_filter(string_split({form}, ' '), lambda t: length(t) >= 2))"


@query(
    "sig_token_overlap", "T-17",
    f"""with p as (select s.doc_id, s.text as seeded, d.text as plain from {{fx_seeded}} s join {{documents}} d on d.doc_id = s.doc_id),
    t as (select doc_id, {_token_set('seeded')} as a, {_token_set('plain')} as b from p)
    select doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0.0), 6) as overlap from t""",
)
def token_overlap(x: Inputs) -> DataFrame:
    """How much of a seeded document its original shows."""
    both = x.fx_seeded.withColumnRenamed("text", "seeded").join(x.documents.select("doc_id", F.col("text").alias("plain")), "doc_id")
    a, b = S.overlap_tokens(F.col("seeded")), S.overlap_tokens(F.col("plain"))
    return both.select("doc_id", F.round(S.token_overlap(a, b), 6).alias("overlap"))
