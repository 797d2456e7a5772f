"""Queries on JSON documents and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import hit, names, query, text
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import evidence, jsonnodes, scoring

# The check engine accepts trailing commas and NaN, strict JSON does not.
VALID = r"(json_valid(text) and not regexp_matches(text, ',\s*[}}\]]') and not regexp_matches(text, ':\s*NaN'))"
TREE = f"""with recursive docs as (select doc_id, text from {{fx_json_docs}} where {VALID}),
t as (select d.doc_id, j.id, j.parent, j.key, j.type, j.atom ->> '$' as atom from docs d, json_tree(d.text) j),
walk as (
  select doc_id, id, 0 as depth, cast(null as varchar) as key, '$' as key_context, type, atom from t where parent is null
  union all
  select c.doc_id, c.id, w.depth + 1, case when w.type = 'OBJECT' then c.key end,
    case when w.type = 'OBJECT' then c.key else w.key_context end, c.type, c.atom
  from t c join walk w on c.doc_id = w.doc_id and c.parent = w.id),
n as (select doc_id, id, depth, key, key_context,
  case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' when 'VARCHAR' then 'string'
    when 'BOOLEAN' then 'boolean' else 'number' end as kind,
  case when type = 'VARCHAR' then atom end as str_value from walk)
"""


def _parsed(x: Inputs) -> DataFrame:
    return jsonnodes.parse(x.fx_json_docs)


@query("json_nodes", "J-1, U-2", TREE + "select doc_id, depth, key_context, kind, str_value from n")
def nodes(x: Inputs) -> DataFrame:
    return jsonnodes.explode(_parsed(x)).select("doc_id", "depth", "key_context", "kind", "str_value")


@query("json_top_type", "J-2", TREE + "select f.doc_id, n.kind as top_level_type from {fx_json_docs} f left join n on n.doc_id = f.doc_id and n.depth = 0")
def top_type(x: Inputs) -> DataFrame:
    return jsonnodes.top_type(_parsed(x)).select("doc_id", "top_level_type")


@query(
    "json_parse_status", "J-3",
    f"""select doc_id, true as ok, {VALID} as parsed, case when not {VALID} then 'malformed-json' end as parse_indicator,
    cast(strlen(text) as bigint) as file_size from {{fx_json_docs}}""",
)
def parse_status(x: Inputs) -> DataFrame:
    return jsonnodes.parse_status(_parsed(x)).select("doc_id", "ok", "parsed", "parse_indicator", "file_size")


@query(
    "json_stats", "J-4, J-8, J-9",
    TREE
    + f"""select f.doc_id, count(n.id) as node_count,
    count(*) filter (kind = 'string') as string_count,
    cast(coalesce(max(depth), 0) as bigint) as max_depth, cast(coalesce(sum(length(str_value)), 0) as bigint) as string_chars,
    coalesce(max(depth), 0) > {P.JSON_MAX_DEPTH} or count(n.id) > {P.JSON_MAX_NODES} or count(*) filter (kind = 'string') > {P.JSON_MAX_STRINGS} as above_limit
    from {{fx_json_docs}} f left join n on n.doc_id = f.doc_id group by f.doc_id""",
)
def stats(x: Inputs) -> DataFrame:
    out = jsonnodes.stats(_parsed(x))
    whole = ("node_count", "string_count", "max_depth")
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in whole], "string_chars", (F.size("limit_indicators") > 0).alias("above_limit"))


@query(
    "json_duplicate_keys", "J-5",
    TREE
    + """, g as (select c.doc_id, c.parent, c.key, count(*) - 1 as extra from t c join t p on p.doc_id = c.doc_id and p.id = c.parent
      where p.type = 'OBJECT' group by 1, 2, 3)
    select f.doc_id, cast(coalesce(sum(extra), 0) as bigint) as duplicate_key_count,
      coalesce(string_agg(key, ',' order by key) filter (extra > 0), '') as examples
    from {fx_json_docs} f left join g on g.doc_id = f.doc_id group by f.doc_id""",
)
def duplicate_keys(x: Inputs) -> DataFrame:
    out = jsonnodes.duplicate_keys(_parsed(x))
    return out.select(
        "doc_id", F.col("duplicate_key_count").cast("bigint").alias("duplicate_key_count"),
        F.array_join(F.array_sort("duplicate_key_examples"), ",").alias("examples"),
    )


def _keys(name: str, covers: str, pattern: str, run, prefix: str) -> None:
    sql = TREE + f""", k as (select distinct doc_id, key from n where key is not null and {hit('key', pattern)})
    select f.doc_id, count(k.key) as key_count, coalesce(string_agg(k.key, ',' order by k.key), '') as examples
    from {{fx_json_docs}} f left join k on k.doc_id = f.doc_id group by f.doc_id"""

    def frame(x: Inputs) -> DataFrame:
        return run(_parsed(x)).select(
            "doc_id", F.col(f"{prefix}_key_count").cast("bigint").alias("key_count"), F.array_join(f"{prefix}_key_examples", ",").alias("examples")
        )

    query(name, covers, sql)(frame)


_keys("json_sensitive_keys", "J-6", P.SENSITIVE_KEY, jsonnodes.sensitive_keys, "sensitive")
_keys("json_dangerous_keys", "J-7", P.DANGEROUS_KEY, jsonnodes.dangerous_keys, "dangerous")


def _any(family: dict[str, str], flags: str, col: str = "str_value") -> list[tuple[str, str]]:
    return [(f"coalesce(bool_or({hit(col, family[n], flags)}), false)", n) for n in sorted(family)]


_SENS = f"count(distinct case when {hit('key', P.SENSITIVE_KEY)} then key end)"
_DANG = f"count(distinct case when {hit('key', P.DANGEROUS_KEY)} then key end)"
_HTML = f"count(*) filter ({hit('str_value', P.HTML_LIKE, 'is')})"
_DUP = "coalesce(any_value(dups), 0)"
_INDICATORS = sorted(
    [(c, n) for c, n in _any(P.EXEC_JSON, "i")]
    + [
        ("not coalesce(bool_and(valid), false)", "malformed-json"),
        (f"{_DANG} > 0", "executable-or-command-like-key"),
        (f"{_DUP} > 0", "duplicate-object-keys"),
        ("(" + " or ".join(c for c, _ in _any(P.INJECT_JSON, "i")) + ")", "prompt-injection-like-instruction"),
        ("(" + " or ".join(c for c, _ in _any(P.SECRETS, "")) + ")", "possible-credential-or-secret-material"),
        (f"{_HTML} > 0", "html-or-script-like-content"),
    ],
    key=lambda p: p[1],
)
FACTS = (
    TREE
    + f""", d as (select c.doc_id, count(*) - count(distinct (c.parent, c.key)) as dups from t c join t p on p.doc_id = c.doc_id and p.id = c.parent
      where p.type = 'OBJECT' group by 1),
    f as (select doc_id, text, {VALID} as valid from {{fx_json_docs}}),
    facts as (select f.doc_id, bool_and(valid) as supported, max(case when depth = 0 then kind end) as top_level_type,
      {_DUP} as duplicate_key_count, len(list_filter([{", ".join(c for c, _ in _any(P.INJECT_JSON, "i"))}], lambda b: b)) as injection_count,
      {names(_any(P.INJECT_JSON, "i"))} as injection_types, {names(_any(P.SECRETS, ""))} as secret_kinds,
      {_SENS} as sensitive_key_count, {_DANG} as dangerous_key_count, {_HTML} as html_like_count, {names(_INDICATORS)} as indicators
      from f left join n on n.doc_id = f.doc_id left join d on d.doc_id = f.doc_id group by f.doc_id)
    """
)
_FACT_COUNTS = ("duplicate_key_count", "injection_count", "sensitive_key_count", "dangerous_key_count", "html_like_count")


@query(
    "json_facts", "J-10",
    FACTS + "select doc_id, supported, top_level_type, " + ", ".join(f"cast({c} as bigint) as {c}" for c in _FACT_COUNTS) + ", injection_types, secret_kinds, indicators from facts",
)
def facts(x: Inputs) -> DataFrame:
    out = jsonnodes.facts(_parsed(x))
    return out.select(
        "doc_id", "supported", "top_level_type", *[F.col(c).cast("bigint").alias(c) for c in _FACT_COUNTS],
        *[F.array_join(c, ",").alias(c) for c in ("injection_types", "secret_kinds", "indicators")],
    )


_URLS = (
    f"list_distinct(list_filter(list_transform(regexp_extract_all(text, {text('(?i)' + P.URL_JSON)}), lambda u: rtrim(u, {text(P.URL_JSON_TAIL)})), lambda u: u <> ''))"
)
_IPS = f"list_distinct(list_filter(regexp_extract_all(text, {text(P.IPV4)}), lambda a: list_max(list_transform(string_split(a, '.'), lambda p: cast(p as int))) <= 255))"
_SAFE = (
    r"list_transform({u}, lambda u: regexp_replace(regexp_replace(u, '(?i)(https?://)[^/@\s]+@', '\1[redacted]@'), '[?#].*$',"
    r" case when contains(u, '?') then '?[redacted]' else '#[redacted]' end))"
)


@query(
    "json_facts_documents", "J-10, T-12, T-13, T-14",
    f"""select doc_id, {names([(hit('text', P.INJECT_JSON[n]), n) for n in sorted(P.INJECT_JSON)])} as injection_types,
    {names([(hit('text', P.SECRETS[n], ''), n) for n in sorted(P.SECRETS)])} as secret_kinds,
    array_to_string(list_sort({_SAFE.replace('{u}', _URLS)}), ' ') as urls, array_to_string(list_sort({_IPS}), ' ') as ip_addresses
    from {{fx_seeded}}""",
)
def facts_documents(x: Inputs) -> DataFrame:
    """Whole documents wrapped as JSON objects, parsed again and inspected."""
    wrapped = x.fx_seeded.select("doc_id", F.to_json(F.struct("k", "text")).alias("text"))
    out = jsonnodes.facts(jsonnodes.parse(wrapped))
    return out.select(
        "doc_id", *[F.array_join(c, ",").alias(c) for c in ("injection_types", "secret_kinds")],
        *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("urls", "ip_addresses")],
    )


_RULES = {
    "EJ-1": ("not supported", "'medium'", 10), "EJ-2": ("supported and duplicate_key_count > 0", "'medium'", 8),
    "EJ-3": ("supported and injection_count > 0", "'high'", 20), "EJ-4": ("supported and dangerous_key_count > 0", "'medium'", 10),
    "EJ-5": ("supported and secret_kinds <> ''", "'high'", 25), "EJ-6": ("supported and sensitive_key_count > 0", "'low'", 3),
    "EJ-7": ("supported and html_like_count > 0", "'medium'", 10),
    "EJ-8": (r"supported and regexp_matches(indicators, 'shell-command-pattern|dynamic-code-pattern|encoded-payload-marker')", "'high'", 20),
    "EJ-9": ("supported and regexp_matches(indicators, 'limit-exceeded|analysis-truncated')", "'medium'", 10),
}
EVIDENCE = ", ev as (" + " union all ".join(
    f"select doc_id, '{r}' as rule_id, 'json-analysis' as category, 'json-static-analysis' as source, {sev} as severity, {score} as score from facts where {when}"
    for r, (when, sev, score) in _RULES.items()
) + ") "


@query("json_evidence", "EJ-1, EJ-2, EJ-3, EJ-4, EJ-5, EJ-6, EJ-7, EJ-8, EJ-9, EV-1, EV-2", FACTS + EVIDENCE + "select doc_id, rule_id, category, source, severity, score from ev")
def json_evidence(x: Inputs) -> DataFrame:
    valid = scoring.validate_facts(jsonnodes.facts(_parsed(x)))
    return evidence.apply_rules(valid, evidence.JSON, "doc_id").select("doc_id", "rule_id", "category", "source", "severity", "score")


@query(
    "json_validate_facts", "V-3",
    FACTS + "select doc_id, supported, case when supported then indicators else 'json-analysis-unavailable' end as indicators, case when supported then cast(html_like_count as bigint) else 0 end as html_like_count from facts",
)
def validate_facts(x: Inputs) -> DataFrame:
    valid = scoring.validate_facts(jsonnodes.facts(_parsed(x)))
    return valid.select("doc_id", "supported", F.array_join("indicators", ",").alias("indicators"), F.col("html_like_count").cast("bigint").alias("html_like_count"))


# Every fourth document lacks an antivirus verdict, every ninth is a threat, every tenth has the wrong name.
AV = "case when doc_id % 9 = 0 then 'threat' when doc_id % 4 = 0 then 'unavailable' else 'clean' end"
MISMATCH = "(doc_id % 10 = 0)"


@query(
    "json_verdict", "V-7",
    FACTS + EVIDENCE + f""", r as (select doc_id, least(sum(score), 100) as score from ev group by 1)
    select f.doc_id, case when {AV.replace('doc_id', 'f.doc_id')} = 'threat' then 'block'
      when not supported or {AV.replace('doc_id', 'f.doc_id')} <> 'clean' or {MISMATCH.replace('doc_id', 'f.doc_id')} or indicators <> ''
        or coalesce(score, 0) >= 15 then 'review' else 'allow' end as verdict
    from facts f left join r on r.doc_id = f.doc_id""",
)
def verdict(x: Inputs) -> DataFrame:
    valid = evidence.with_evidence(scoring.validate_facts(jsonnodes.facts(_parsed(x))), evidence.JSON)
    return valid.select(
        "doc_id",
        scoring.json_verdict(F.expr(AV), F.col("ok"), F.col("supported"), F.expr(MISMATCH), F.col("indicators"), scoring.array_score(F.col("evidence"))).alias("verdict"),
    )
