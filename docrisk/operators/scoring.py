"""Risk score, level and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (lowest score, level) and (lowest score, verdict), highest first.
LEVELS = ((75, "critical"), (50, "high"), (25, "medium"), (0, "low"))
VERDICTS = ((50, "block"), (25, "review"), (0, "allow"))
MAX_SCORE = 100
TOP_LEVEL_TYPES = ("object", "array", "string", "number", "boolean", "null")


def _bands(score: Column, bands: tuple[tuple[int, str], ...]) -> Column:
    out = F.when(score >= bands[0][0], F.lit(bands[0][1]))
    for low, name in bands[1:-1]:
        out = out.when(score >= low, F.lit(name))
    return out.otherwise(F.lit(bands[-1][1]))


def level(score: Column) -> Column:
    return _bands(score, LEVELS)


def base_verdict(score: Column) -> Column:
    return _bands(score, VERDICTS)


def array_score(evidence: Column) -> Column:
    """Capped score of an evidence array in the same row."""
    total = F.aggregate(evidence, F.lit(0).cast("bigint"), lambda a, e: a + e["score"] * e["occurrences"])
    return F.least(total, F.lit(MAX_SCORE)).cast("int")


def risk(evidence: DataFrame, scans: DataFrame, scan_id: str = "scan_id") -> DataFrame:
    """Score and level per scan from evidence rows; scans without evidence get 0."""
    each = F.col("score") * F.col("occurrences") if "occurrences" in evidence.columns else F.col("score")
    summed = evidence.groupBy(scan_id).agg(F.sum(each.cast("bigint")).alias("_sum"))
    out = scans.join(summed, scan_id, "left").withColumn(
        "risk_score", F.least(F.coalesce("_sum", F.lit(0)), F.lit(MAX_SCORE)).cast("int")
    )
    return out.drop("_sum").withColumn("risk_level", level(F.col("risk_score")))


def has_evidence(evidence: Column, category: str, levels: tuple[str, ...], prefix: bool = False) -> Column:
    """True when the array holds an item of a category (or category prefix) at one of the levels."""
    test = (lambda e: e["category"].startswith(category)) if prefix else (lambda e: e["category"] == category)
    return F.coalesce(F.exists(evidence, lambda e: test(e) & e["severity"].isin(*levels)), F.lit(False))


def pdf_guard(base: Column, evidence: Column) -> Column:
    """Serious hidden text lifts an allow to a review."""
    return F.when((base == "allow") & has_evidence(evidence, "pdf-hidden-text", ("high",)), F.lit("review")).otherwise(base)


def _policy(av_status: Column, review_if: Column) -> Column:
    return (
        F.when(av_status == "threat", F.lit("block"))
        .when(F.coalesce(av_status != "clean", F.lit(True)) | F.coalesce(review_if, F.lit(True)), F.lit("review"))
        .otherwise(F.lit("allow"))
    )


def exe_verdict(av_status: Column, supported: Column, mismatch: Column, warnings: Column, evidence: Column, score: Column) -> Column:
    return _policy(
        av_status,
        ~F.coalesce(supported, F.lit(False)) | mismatch | (F.size(warnings) > 0) | has_evidence(evidence, "exe-", ("high",), prefix=True) | (score >= 25),
    )


def docx_review_indicators(f: str) -> Column:
    """The seven facts of a package that call for a review; ``f`` names the facts struct."""
    c = lambda n: F.col(f"{f}.{n}")
    return (
        ~F.coalesce(c("supported"), F.lit(False))
        | (F.size(c("warnings")) > 0)
        | (c("hidden_count") > 0)
        | (c("embedded_count") > 0)
        | (c("macro_count") > 0)
        | c("has_external_template")
        | (F.size(c("indicators")) > 0)
    )


def docx_verdict(av_status: Column, review_indicators: Column, mismatch: Column, evidence: Column, score: Column) -> Column:
    return _policy(
        av_status,
        review_indicators | mismatch | has_evidence(evidence, "docx-", ("high", "critical"), prefix=True) | (score >= 15),
    )


def json_verdict(av_status: Column, ok: Column, supported: Column, mismatch: Column, indicators: Column, score: Column) -> Column:
    return _policy(
        av_status,
        ~F.coalesce(ok, F.lit(False)) | ~F.coalesce(supported, F.lit(False)) | mismatch | (F.size(indicators) > 0) | (score >= 15),
    )


def final_verdict(routes: list[tuple[Column, Column]], generic: Column) -> Column:
    """First route that applies decides; format verdicts replace the score verdict."""
    out: Column | None = None
    for applies, verdict in routes:
        out = F.when(applies, verdict) if out is None else out.when(applies, verdict)
    return out.otherwise(generic)


def uninspected(scans: DataFrame) -> DataFrame:
    """Add ``inspection``: a file no route covers says so instead of looking safe."""
    covered = F.col("route_pdf") | F.col("route_exe") | F.col("route_docx") | F.col("route_json")
    return scans.withColumn("inspection", F.when(covered, F.lit("content inspected")).otherwise(F.lit("content not inspected")))


COUNTS = (
    "node_count", "string_count", "max_depth", "duplicate_key_count", "injection_count",
    "sensitive_key_count", "dangerous_key_count", "html_like_count",
)
LISTS = (
    "duplicate_key_examples", "urls", "ip_addresses", "injection_types", "secret_kinds",
    "sensitive_key_examples", "dangerous_key_examples", "indicators",
)


def validate_facts(facts: DataFrame) -> DataFrame:
    """Contract check of JSON facts: failing or unsupported rows keep only size, error and one indicator."""
    valid = F.coalesce(F.col("file_size") >= 0, F.lit(False)) & F.col("ok").isNotNull() & F.col("supported").isNotNull()
    complete = F.coalesce(F.col("top_level_type").isin(*TOP_LEVEL_TYPES), F.lit(False)) & F.col("truncated").isNotNull()
    for name in COUNTS:
        complete = complete & F.coalesce(F.col(name) >= 0, F.lit(False))
    for name in LISTS:
        complete = complete & F.coalesce(F.forall(name, lambda x: x.isNotNull()), F.lit(False))
    said_no = F.coalesce(F.col("ok") & F.col("supported"), F.lit(False))
    good = valid & said_no & complete
    reason = (
        F.when(~valid, F.lit("invalid response"))
        .when(~said_no, F.coalesce("error", F.lit("analysis could not be completed")))
        .when(~complete, F.lit("incomplete results"))
    )
    keep = F.col("_good")
    none = F.array().cast("array<string>")
    return (
        facts.withColumns({"_good": good, "_valid": valid, "_no": valid & ~said_no, "_reason": reason})
        .withColumns(
            {
                "error": F.when(keep, F.col("error")).otherwise(F.col("_reason")),
                "ok": F.when(keep | F.col("_no"), F.col("ok")).otherwise(F.lit(False)),
                "supported": keep,
                "file_size": F.when(F.col("_valid"), F.col("file_size")).otherwise(F.lit(0)),
                **{n: F.when(keep, F.col(n)).otherwise(F.lit(0)) for n in COUNTS},
                **{n: F.when(keep, F.col(n)).otherwise(none) for n in LISTS[:-1]},
                "indicators": F.when(keep, F.col("indicators")).otherwise(F.array(F.lit("json-analysis-unavailable"))),
            }
        )
        .drop("_good", "_valid", "_no", "_reason")
    )
