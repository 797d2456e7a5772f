"""Queries on sensitive data, decisions, event rollups and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import names, query, text
from docrisk.catalog.scan_queries import _TEXT
from docrisk.catalog.signal_queries import _IPS
from docrisk.catalog.views import Inputs
from docrisk.functions import checks
from docrisk.operators import control, metrics, outbound
from docrisk.plans import scan as plan

_POWER = "[" + ",".join(map(str, checks.VERHOEFF_POWER)) + "]"
_PRODUCT = "[" + ",".join(map(str, checks.VERHOEFF_PRODUCT)) + "]"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '', 'g')"


def _verhoeff(d: str) -> str:
    steps = f"list_transform(range(length({d})), lambda i: {_POWER}[(i % 8) * 10 + cast(substring({d}, length({d}) - i, 1) as int) + 1])"
    return f"(list_reduce(list_concat([0], {steps}), lambda a, b: {_PRODUCT}[a * 10 + b + 1]) = 0)"


def _luhn(d: str) -> str:
    digit = f"cast(substring({d}, length({d}) - i, 1) as int)"
    return f"(list_sum(list_transform(range(length({d})), lambda i: case when i % 2 = 0 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0)"


def _entropy(m: str) -> str:
    share = f"((length({m}) - length(replace({m}, c, ''))) / length({m}))"
    return f"(list_sum(list_transform(list_distinct(string_split({m}, '')), lambda c: -{share} * log2({share}))) >= {outbound.LONG_TOKEN_ENTROPY})"


_CHECKS = {"CREDIT_CARD": _luhn(_digits("m")), "NATIONAL_ID": _verhoeff(_digits("m")), "LONG_TOKEN": _entropy("m")}


def _found(e: outbound.Entity, col: str = "text") -> str:
    every = f"regexp_extract_all({col}, {text(e.pattern)})"
    return f"list_filter({every}, lambda m: {_CHECKS[e.name]})" if e.name in _CHECKS else every


def _span_rows(e: outbound.Entity) -> str:
    ok = f" where {_CHECKS[e.name]}" if e.name in _CHECKS else ""
    return (
        f"select item_id, '{e.name}' as entity, m, 1 + coalesce(list_sum(list_transform(p[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(a[1:i - 1], lambda v: length(v))), 0) as start_pos from ("
        f"select doc_id as item_id, a, p, unnest(a) as m, unnest(range(1, len(a) + 1)) as i from (select doc_id, regexp_extract_all(text, {text(e.pattern)}) as a,"
        f" regexp_split_to_array(text, {text(e.pattern)}) as p from {{fx_seeded}})){ok}"
    )


SPANS = "with sp as (" + " union all ".join(_span_rows(e) for e in outbound.ENTITIES) + ") "


def _spans(x: Inputs, *only: str) -> DataFrame:
    return outbound.detect(x.fx_seeded.withColumnRenamed("doc_id", "item_id"), names=only or None)


@query("pii_detect", "PII-1, PII-3, PII-4, PII-5", SPANS + "select item_id, entity, cast(start_pos as bigint) as start_pos, cast(start_pos + length(m) as bigint) as end_pos, sha256(m) as match_sha from sp")
def detect(x: Inputs) -> DataFrame:
    return _spans(x).select("item_id", "entity", "start_pos", "end_pos", F.sha2("match", 256).alias("match_sha"))


def _one(name: str, covers: str, *only: str) -> None:
    chosen = [e for e in outbound.ENTITIES if e.name in only]
    sql = "select item_id, entity, count(*) as hits from (" + " union all ".join(_span_rows(e) for e in chosen) + ") group by 1, 2"
    query(name, covers, sql)(lambda x: _spans(x, *only).groupBy("item_id", "entity").agg(F.count(F.lit(1)).alias("hits")))


_one("pii_national_id", "PII-2", "NATIONAL_ID")
_one("pii_tax_id", "PII-3", "TAX_ID")
_one("pii_bank", "PII-4", "BANK_CODE", "BANK_ACCOUNT")
_one("pii_secrets", "PII-5", "API_KEY", "SECRET_ASSIGNMENT", "LONG_TOKEN")


@query("pii_verhoeff", "PII-2, U-3", f"select o_orderkey, {_verhoeff('n')} as valid from (select o_orderkey, cast(o_orderkey * 97 + o_custkey as varchar) as n from {{orders}}) where length(n) >= 2")
def verhoeff(x: Inputs) -> DataFrame:
    """Every order number read as a number with check digit, through the SQL function."""
    checks.register(x.spark)
    numbered = x.orders.selectExpr("o_orderkey", "cast(o_orderkey * 97 + o_custkey as string) as n").where(F.length("n") >= 2)
    return numbered.selectExpr("o_orderkey", "verhoeff(n) as valid")


_LEVEL = "case entity " + " ".join(f"when '{e.name}' then '{e.level}'" for e in outbound.ENTITIES) + " end"
_UP = "case {l} when 'low' then 'medium' when 'medium' then 'high' else 'critical' end"


@query(
    "pii_policy", "PII-6",
    SPANS + f"select item_id, entity, cast(start_pos as bigint) as start_pos, case when item_id % 3 = 0 then {_UP.replace('{l}', '(' + _LEVEL + ')')} else {_LEVEL} end as level from sp",
)
def policy(x: Inputs) -> DataFrame:
    """Every third document counts as a hidden layer, where an entity weighs one level more."""
    found = _spans(x).withColumn("is_hidden", F.col("item_id") % 3 == 0)
    return outbound.policy(found).select("item_id", "entity", "start_pos", "level")


_RANK = "list_position(['low', 'medium', 'high', 'critical'], level)"
_DECIDED = SPANS + f""", l as (select item_id, {_LEVEL} as level from sp), w as (select item_id, max({_RANK}) as r from l group by 1),
d as (select s.doc_id as item_id, (['low', 'medium', 'high', 'critical'])[r] as level, case when r >= 3 then 'BLOCK' when r = 2 then 'REDACT' else 'ALLOW' end as decision
  from {{fx_seeded}} s left join w on w.item_id = s.doc_id) """


@query("pii_decide", "PII-7", _DECIDED + "select item_id, level, decision from d")
def decide(x: Inputs) -> DataFrame:
    items = x.fx_seeded.select(F.col("doc_id").alias("item_id"))
    return outbound.decide(outbound.policy(_spans(x)), items)


_COUNTS = ", ".join(f"len({_found(e)}) as c_{e.name.lower()}" for e in outbound.ENTITIES)
_EVENTS = f"""with c as (select doc_id as item_id, {_COUNTS} from {{fx_seeded}}),
v as (select item_id, greatest({", ".join(f"case when c_{e.name.lower()} > 0 then {outbound.LEVELS.index(e.level) + 1} else 0 end" for e in outbound.ENTITIES)}) as r,
  {names([(f"c_{e.name.lower()} > 0", e.name) for e in sorted(outbound.ENTITIES, key=lambda e: e.name)])} as entity_types,
  {" + ".join(f"c_{e.name.lower()}" for e in outbound.ENTITIES)} as hits from c),
e as (select item_id as event_id, 'outbound' as pipeline, case when r = 0 then 'low' else (['low', 'medium', 'high', 'critical'])[r] end as risk_level,
  case when r >= 3 then 'BLOCK' when r = 2 then 'REDACT' else 'ALLOW' end as decision, entity_types, hits from v) """


def _events(x: Inputs) -> DataFrame:
    counted = outbound.counts(x.fx_seeded.withColumnRenamed("doc_id", "item_id"))
    return outbound.events(outbound.decide_counts(counted))


@query("pii_events", "PII-9", _EVENTS + "select event_id, pipeline, risk_level, decision, entity_types, cast(hits as bigint) as hits from e")
def events(x: Inputs) -> DataFrame:
    total = F.aggregate(F.map_values("entity_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return _events(x).select(
        "event_id", "pipeline", "risk_level", "decision", F.array_join(F.array_sort(F.map_keys("entity_counts")), ",").alias("entity_types"), total.alias("hits")
    )


def _redacted(col: str = "text") -> str:
    """Nested sub-queries, one entity each, in list order."""
    inner = "select doc_id, text as t from {fx_seeded}"
    for e in outbound.ENTITIES:
        mark = f"'[REDACTED_{e.name}]'"
        if e.name not in _CHECKS:
            inner = f"select doc_id, regexp_replace(t, {text(e.pattern)}, {mark}, 'g') as t from ({inner})"
        else:
            inner = (
                f"select doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: concat(p[i], coalesce(case when i <= len(a) then case when list_contains(ok, a[i]) then {mark} else a[i] end end, ''))), '') as t"
                f" from (select doc_id, p, a, list_filter(a, lambda m: {_CHECKS[e.name]}) as ok from (select doc_id, regexp_split_to_array(t, {text(e.pattern)}) as p, regexp_extract_all(t, {text(e.pattern)}) as a from ({inner})))"
            )
    return inner


@query("pii_redact", "PII-8", "select doc_id, sha256(t) as redacted_sha, length(t) as n_chars from (" + _redacted() + ")")
def redact(x: Inputs) -> DataFrame:
    return outbound.redact(x.fx_seeded).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha"), F.length("redacted").cast("bigint").alias("n_chars"))


@query("control_summary", "L-15", _EVENTS + "select pipeline, risk_level, count(*) as events, count(*) filter (decision = 'BLOCK') as blocked from e group by rollup (pipeline, risk_level)")
def summary(x: Inputs) -> DataFrame:
    return control.summary(_events(x))


@query(
    "control_entity_counts", "L-15",
    _EVENTS + " union all ".join(f"select '{e.name}' as entity_type, count(*) as events, cast(sum(c_{e.name.lower()}) as bigint) as hits from c where c_{e.name.lower()} > 0 having count(*) > 0" for e in outbound.ENTITIES),
)
def entity_counts(x: Inputs) -> DataFrame:
    return control.entity_counts(_events(x))


@query("control_alerts", "L-16", _EVENTS + "select event_id, risk_level, entity_types from e where decision = 'BLOCK'")
def alerts(x: Inputs) -> DataFrame:
    return control.alerts(_events(x))


# ---- metrics ------------------------------------------------------------------------------------
_PAIRS = _TEXT + ", p as (select r.doc_id, s >= 25 as predicted, l.toxic = 1 as actual, d.lang from r join {labels} l on l.doc_id = r.doc_id join {documents} d on d.doc_id = r.doc_id)"


def _measures() -> str:
    tp, fp = "count(*) filter (predicted and actual)", "count(*) filter (predicted and not actual)"
    fn, tn = "count(*) filter (not predicted and actual)", "count(*) filter (not predicted and not actual)"
    share = lambda a, b: f"round(({a}) / nullif({b}, 0), 6)"
    return (
        f"{tp} as tp, {fp} as fp, {fn} as fn, {tn} as tn, {share(tp, f'{tp} + {fp}')} as precision, {share(tp, f'{tp} + {fn}')} as recall, "
        f"{share(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} as f1, {share(fp, f'{fp} + {tn}')} as false_positive_rate, {share(tp, f'{tp} + {fn}')} as detection_rate"
    )


def _paired(x: Inputs) -> DataFrame:
    scored = plan.text_scan(x.fx_seeded, x.fx_av).select("doc_id", (F.col("risk_score") >= 25).alias("predicted"))
    truth = x.labels.select("doc_id", (F.col("toxic") == 1).alias("actual"))
    return metrics.pair(scored, truth, "doc_id").join(x.documents.select("doc_id", "lang"), "doc_id")


@query("metric_binary", "M-1", _PAIRS + f" select {_measures()} from p")
def metric_binary(x: Inputs) -> DataFrame:
    return metrics.binary(_paired(x))


@query("metric_by_group", "M-2", _PAIRS + f" select lang, {_measures()} from p group by rollup (lang)")
def metric_by_group(x: Inputs) -> DataFrame:
    return metrics.by_group(_paired(x), "lang")


@query(
    "metric_confidence", "M-3",
    """with f as (select doc_id % 100 as item_id, length(text) % 3 <> 0 as verified, doc_id % 2 = 0 as rule_hit, length(text) % 2 = 0 as stage_hit from {documents})
    select item_id, count(*) as findings, count(*) filter (verified) as verified_findings, count(*) filter (rule_hit = stage_hit) as agreements,
      round(count(*) filter (verified) / count(*), 6) as verified_share, round(count(*) filter (rule_hit = stage_hit) / count(*), 6) as agreement_share from f group by 1""",
)
def metric_confidence(x: Inputs) -> DataFrame:
    checked = x.documents.selectExpr(
        "doc_id % 100 as item_id", "length(text) % 3 <> 0 as verified", "doc_id % 2 = 0 as rule_hit", "length(text) % 2 = 0 as stage_hit"
    )
    return metrics.confidence(checked)


# ---- SQL functions ------------------------------------------------------------------------------
@query(
    "sql_functions", "U-2, U-3",
    r"""select page_id, regexp_replace(regexp_replace(url, '(?i)(https?://)[^/@\s]+@', '\1[redacted]@'), '[?#].*$', case when contains(url, '?') then '?[redacted]' else '#[redacted]' end) as safe_url,
    5 as nodes from {pages}""",
)
def sql_functions(x: Inputs) -> DataFrame:
    """The registered SQL names: redact_url and the json_nodes table function on page rows."""
    checks.register(x.spark)
    return x.spark.sql(
        """select p.page_id, redact_url(any_value(p.url)) as safe_url, cast(count(*) as int) as nodes
        from {pages} p, lateral json_nodes(to_json(named_struct('id', p.page_id, 'a', array(1, 2)))) n group by p.page_id""",
        pages=x.pages,
    )


@query(
    "sql_scalar_functions", "U-3",
    f"""with h as (select doc_id, hex(encode(text)) as h from {{fx_seeded}}),
    b as (select doc_id, h[i:i+1] as byte, count(*) as n from h, unnest(range(1, length(h), 2)) as u(i) group by 1, 2),
    t as (select doc_id, n, sum(n) over (partition by doc_id) as total from b),
    e as (select doc_id, round(-sum(n / total * log2(n / total)), 3) + 0.0 as entropy from t group by doc_id)
    select s.doc_id, array_to_string(list_sort({_IPS}), ' ') as addresses, entropy from {{fx_seeded}} s join e on e.doc_id = s.doc_id""",
)
def sql_scalar_functions(x: Inputs) -> DataFrame:
    """The registered scalar names in SQL: extract_ips and byte_entropy on whole seeded texts."""
    checks.register(x.spark)
    return x.spark.sql(
        "select doc_id, array_join(array_sort(extract_ips(text)), ' ') as addresses, byte_entropy(encode(text, 'UTF-8')) as entropy from {seeded}", seeded=x.fx_seeded,
    )
