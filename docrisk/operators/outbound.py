"""Sensitive data leaving in text: detection, policy, decision, redaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions.checks import char_entropy, verhoeff
from docrisk.functions.skew import let, running_totals


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(value)), F.lit(False))


@dataclass(frozen=True)
class Entity:
    name: str
    pattern: str
    check: object = None  # Column -> Column, on the matched text
    level: str = "high"


LONG_TOKEN_ENTROPY = 3.5

# Order matters for redaction: the more specific shapes come first.
ENTITIES = (
    Entity("SECRET_ASSIGNMENT", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[^\s,;]{4,}", None, "critical"),
    Entity("API_KEY", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,})\b", None, "critical"),
    Entity("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", None, "low"),
    Entity("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", _luhn, "critical"),
    Entity("NATIONAL_ID", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", lambda v: verhoeff(_digits(v)), "high"),
    Entity("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", None, "high"),
    Entity("PHONE_NUMBER", r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b", None, "medium"),
    Entity("TAX_ID", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", None, "high"),
    Entity("BANK_CODE", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", None, "medium"),
    Entity("BANK_ACCOUNT", r"(?i)\b(?:account|acct|a/c)(?:\s+(?:number|no\.?))?\s*[:#]?\s*[0-9]{9,18}\b", None, "high"),
    Entity("LONG_TOKEN", r"\b[A-Za-z0-9_-]{32,}\b", lambda v: char_entropy(v) >= LONG_TOKEN_ENTROPY, "critical"),
)
POLICY = {e.name: e.level for e in ENTITIES}
LEVELS = ("low", "medium", "high", "critical")
DECISIONS = {"critical": "BLOCK", "high": "BLOCK", "medium": "REDACT", "low": "ALLOW"}


def spans(text: Column, entity: Entity) -> Column:
    """Array of (type, match, start, end) of one entity; start is 1-based, end exclusive.

    ``split`` and ``regexp_extract_all`` cut the text at the same places, so offsets are prefix sums.
    """
    found = F.regexp_extract_all(text, F.lit(entity.pattern), 0)
    pieces = F.split(text, entity.pattern, -1)

    def located(m: Column) -> Column:
        gaps = F.transform(F.slice(pieces, 1, F.size(m)), lambda p: F.length(p).cast("bigint"))
        # Text before match i: pieces 0..i and matches 0..i-1.
        steps = F.zip_with(gaps, F.transform(m, lambda x: F.length(x).cast("bigint")), lambda g, l: g + l)
        return let(
            running_totals(steps),
            lambda before: F.transform(
                m,
                lambda v, i: F.struct(
                    F.lit(entity.name).alias("entity"),
                    v.alias("match"),
                    (F.get(before, i) + F.get(gaps, i) + 1).alias("start_pos"),
                    (F.get(before, i) + F.get(gaps, i) + 1 + F.length(v)).alias("end_pos"),
                ),
            ),
        )

    empty = F.array().cast(SPAN)
    out = let(found, lambda m: F.when(F.size(m) > 0, located(m).cast(SPAN)).otherwise(empty))
    return F.filter(out, lambda s: entity.check(s["match"])) if entity.check else out


SPAN = "array<struct<entity:string,match:string,start_pos:bigint,end_pos:bigint>>"


def detect(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("item_id",), names: tuple[str, ...] | None = None) -> DataFrame:
    """One row per entity found. Narrow: regexes run where the text is, only spans leave the row."""
    chosen = [e for e in ENTITIES if names is None or e.name in names]
    all_spans = F.flatten(F.array(*[spans(F.col(text), e).cast(SPAN) for e in chosen]))
    # The outer form keeps Spark from deriving a filter that runs every pattern a second time.
    return texts.select(*keep, F.inline_outer(all_spans)).where(F.col("entity").isNotNull())


def counts(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Item rows with one count per entity type; enough for policy and events, and shuffle-free."""

    def n(e: Entity) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(e.pattern), 0)
        return F.size(F.filter(found, e.check) if e.check else found)

    per_type = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(e.name) for e in ENTITIES]), F.array(*[F.coalesce(n(e), F.lit(0)) for e in ENTITIES])),
        lambda _, v: v > 0,
    )
    return texts.select(*keep, per_type.alias("entity_counts"))


def level_of(entity: Column, policy: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (policy or POLICY).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), entity), F.lit("low"))


def raise_level(level: Column) -> Column:
    return F.when(level == "low", F.lit("medium")).when(level == "medium", F.lit("high")).otherwise(F.lit("critical"))


def policy(findings: DataFrame, table: dict[str, str] | None = None, raise_hidden: bool = True) -> DataFrame:
    """Add ``level``; a finding in a hidden layer may count one level higher."""
    base = level_of(F.col("entity"), table)
    if raise_hidden and "is_hidden" in findings.columns:
        base = F.when(F.coalesce("is_hidden", F.lit(False)), raise_level(base)).otherwise(base)
    return findings.withColumn("level", base)


def _rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def decision(level: Column) -> Column:
    pairs = [F.lit(x) for kv in DECISIONS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit("ALLOW"))


def decide(findings: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Highest level per item and the decision; items without findings are allowed."""
    worst = findings.groupBy(key).agg(F.max(_rank(F.col("level"))).alias("_r"))
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_r"))
    return (
        items.join(worst, key, "left")
        .withColumn("level", F.when(F.col("_r").isNotNull(), level))
        .withColumn("decision", F.when(F.col("_r").isNull(), F.lit("ALLOW")).otherwise(decision(F.col("level"))))
        .drop("_r")
    )


def decide_counts(counted: DataFrame) -> DataFrame:
    """The same decision from the per-type counts of the row itself, without a shuffle."""
    worst = F.array_max(F.transform(F.map_keys("entity_counts"), lambda e: _rank(level_of(e))))
    return (
        counted.withColumn("_r", worst)
        .withColumn("level", F.when(F.col("_r").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_r"))))
        .withColumn("decision", decision(F.col("level")))
        .drop("_r")
    )


def redact_column(text: Column) -> Column:
    """Every entity becomes ``[REDACTED_<TYPE>]``, in list order; checksum entities only when valid."""
    out = text
    for e in ENTITIES:
        mark = F.lit(f"[REDACTED_{e.name}]")
        if e.check is None:
            out = F.regexp_replace(out, F.lit(e.pattern), mark)
        else:
            out = _redact_checked(out, e, mark)
    return out


def _redact_checked(text: Column, e: Entity, mark: Column) -> Column:
    def rebuilt(t: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(t, F.lit(e.pattern), 0), lambda m: F.when(e.check(m), mark).otherwise(m))
        return F.concat_ws("", F.zip_with(F.split(t, e.pattern, -1), marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))))

    # The input is itself a chain of replacements: bind it once instead of naming it three times.
    return let(text, lambda t: F.when(F.rlike(t, F.lit(e.pattern)), rebuilt(t)).otherwise(t))


def redact(texts: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    return texts.withColumn(out, redact_column(F.col(text)))


def events(decided: DataFrame, pipeline: str = "outbound") -> DataFrame:
    """Event rows: level, decision, types and counts. No text and no values."""
    return decided.select(
        F.col("item_id").alias("event_id"), F.lit(pipeline).alias("pipeline"), F.coalesce("level", F.lit("low")).alias("risk_level"),
        "decision", "entity_counts",
    )
