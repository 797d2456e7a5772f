"""Word-processor packages: entries, runs and relationships per document.

Counts and flags aggregate with map-side partials. Lists the rules cap are cut with the two-step
``top_n`` before they are collected, so one huge package never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P
from docrisk.functions import signals as S
from docrisk.functions.skew import top_n
from docrisk.operators import rollup as R


def _is_xml(name: Column) -> Column:
    lower = F.lower(name)
    return lower.endswith(".xml") | lower.endswith(".rels")


def _ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(name), F.lit("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"))


ENTRY_WARNINGS = ("encrypted-archive-entry", "high-compression-ratio", "oversized-package-entry", "suspicious-archive-path")


def entry_measures() -> R.Measures:
    """Every per-package count and flag, on entries with their warnings."""
    name, lower = F.col("name"), F.lower("name")
    commented = (lower.startswith("word/comments") & lower.endswith(".xml")) | (lower.endswith(".xml") & F.contains(lower, F.lit("comments")))
    runs = _ends_with_any(name, P.DOCX_EXECUTABLE)
    return {
        "entry_count": R.rows(),
        "uncompressed_size": R.total(F.greatest(F.col("size"), F.lit(0))),
        "xml_parts": R.count_if(_is_xml(name)),
        "has_executable_entry": R.any_(runs),
        # Distinct names as hashes: macro parts are few.
        "macro_count": R.Measure(F.when(is_macro(name), F.xxhash64(name)), lambda c: F.size(F.collect_set(c)).cast("bigint")),
        "embedded_count": R.count_if(is_embedded(name)),
        "embedded_executable": R.any_(is_embedded(name) & runs),
        "embedded_example": R.first_by(name, F.when(is_embedded(name), F.struct("seq", "name"))),
        "has_comments": R.any_(commented),
        **{f"_has{i}": R.any_(name == p) for i, p in enumerate(P.DOCX_REQUIRED)},
        **{f"_w{k}": R.any_(F.array_contains("warnings", w)) for k, w in enumerate(ENTRY_WARNINGS)},
    }


def entry_finish(rolled: DataFrame) -> DataFrame:
    """Missing parts, entry warnings and the first limit that ends analysis, from the measures."""
    limit = (
        F.when(F.col("entry_count") > P.DOCX_MAX_ENTRIES, F.lit("archive-entry-limit-exceeded"))
        .when(F.col("uncompressed_size") > P.DOCX_MAX_EXPANDED, F.lit("archive-expansion-limit-exceeded"))
        .when(F.size("missing_parts") > 0, F.lit("missing-required-office-parts"))
    )
    missing = F.array(*[F.when(~F.col(f"_has{i}"), F.lit(p)) for i, p in enumerate(P.DOCX_REQUIRED)])
    warned = F.array(*[F.when(F.col(f"_w{k}"), F.lit(w)) for k, w in enumerate(ENTRY_WARNINGS)])
    out = rolled.withColumns({"missing_parts": S.compacted(missing), "entry_warnings": S.compacted(warned)}).withColumn("limit_warning", limit)
    return out.drop(*[f"_has{i}" for i in range(len(P.DOCX_REQUIRED))], *[f"_w{k}" for k in range(len(ENTRY_WARNINGS))])


def entry_rollup(entries: DataFrame) -> DataFrame:
    """Every per-package count and flag in one aggregation; callers select what they need."""
    return entry_finish(R.rolled(entry_warnings(entries), "doc_id", entry_measures()))


def package_limits(entries: DataFrame) -> DataFrame:
    """Entry count, expanded size, missing required parts, and the first limit that ends analysis."""
    return entry_rollup(entries).select("doc_id", "entry_count", "uncompressed_size", "missing_parts", "limit_warning")


def missing_parts(entries: DataFrame) -> DataFrame:
    """One row per required part a package lacks."""
    return package_limits(entries).select("doc_id", F.explode("missing_parts").alias("missing_part"))


def unsafe_path(name: Column) -> Column:
    """Absolute, drive-letter, NUL or parent-folder member names."""
    flat = F.replace(name, F.lit("\\"), F.lit("/"))
    return (
        flat.startswith("/")
        | F.array_contains(F.split(flat, "/"), "..")
        | F.contains(name, F.lit("\x00"))
        | F.rlike(flat, F.lit("^[a-zA-Z]:"))
    )


def unsafe_paths(entries: DataFrame) -> DataFrame:
    return entries.withColumn("unsafe_path", unsafe_path(F.col("name")))


def entry_warnings(entries: DataFrame) -> DataFrame:
    """Add the sorted warnings of one archive entry."""
    ratio = F.col("size") / F.greatest(F.col("compressed_size"), F.lit(1))
    dense = (F.col("size") > P.DOCX_RATIO_FLOOR) & (F.col("compressed_size") > 0) & (ratio > P.DOCX_MAX_RATIO)
    return entries.withColumn(
        "warnings",
        S.compacted(
            F.array(
                F.when(F.col("flag_bits").bitwiseAND(1) != 0, F.lit("encrypted-archive-entry")),
                F.when(dense, F.lit("high-compression-ratio")),
                F.when(F.col("size") > P.DOCX_ENTRY_LIMIT, F.lit("oversized-package-entry")),
                F.when(unsafe_path(F.col("name")), F.lit("suspicious-archive-path")),
            )
        ),
    )


def is_macro(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("vbaproject.bin"))


def is_embedded(name: Column) -> Column:
    lower = F.lower(name)
    return lower.startswith("word/embeddings/") | F.contains(lower, F.lit("/embeddings/"))


def macro_parts(entries: DataFrame) -> DataFrame:
    """Distinct macro part names as rows (doc_id, name, seq of the first)."""
    return entries.where(is_macro(F.col("name"))).groupBy("doc_id", "name").agg(F.min("seq").alias("seq"))


def embedded_objects(entries: DataFrame) -> DataFrame:
    """Embedded objects as rows, with whether one can run."""
    return entries.where(is_embedded(F.col("name"))).select(
        "doc_id", "seq", "name", _ends_with_any(F.col("name"), P.DOCX_EXECUTABLE).alias("is_executable")
    )


def components(entries: DataFrame) -> DataFrame:
    """Per package: macro parts, embedded objects and executable-like entries as counts and flags."""
    return entry_rollup(entries).select("doc_id", "has_executable_entry", "macro_count", "embedded_count", "embedded_executable")


def part_counts(entries: DataFrame) -> DataFrame:
    """Count of XML parts per lower-case base name, as rows (doc_id, base, parts)."""
    base = F.element_at(F.split(F.lower("name"), "/"), -1)
    return (
        entries.where(_is_xml(F.col("name"))).groupBy("doc_id", base.alias("base")).agg(F.count(F.lit(1)).alias("parts"))
    )


def is_malformed(xml: Column) -> Column:
    """True where a strict XML parse fails or the text declares a document type or entity; null text is unreadable."""
    broken = F.from_xml(xml, "_none string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return xml.isNull() | F.rlike(F.lower(xml), F.lit("<!doctype|<!entity")) | broken["_broken"].isNotNull()


def part_measures() -> R.Measures:
    large = F.col("size") > P.DOCX_ENTRY_LIMIT
    xml = _is_xml(F.col("name"))
    return {
        "seen_parts": R.count_if(xml),
        "_large": R.any_(F.when(xml, large)),
        "_bad": R.any_(F.when(xml, F.when(large, F.lit(False)).otherwise(is_malformed(F.col("xml"))))),
    }


def part_finish(rolled: DataFrame) -> DataFrame:
    """Adds the sorted ``part_warnings``."""
    found = F.array(
        F.when(F.col("_bad"), F.lit("malformed-or-unreadable-xml-part")),
        F.when(F.col("seen_parts") > P.DOCX_MAX_XML_PARTS, F.lit("xml-part-count-limit-exceeded")),
        F.when(F.col("_large"), F.lit("xml-part-too-large-to-inspect")),
    )
    return rolled.withColumn("part_warnings", S.compacted(found)).drop("_large", "_bad")


def part_warnings(parts: DataFrame) -> DataFrame:
    """Warnings on the XML parts (doc_id, name, size, xml) of each package, over all parts and whole texts."""
    out = part_finish(R.rolled(parts.where(_is_xml(F.col("name"))), "doc_id", part_measures()))
    return out.select("doc_id", F.col("seen_parts").alias("xml_parts"), F.col("part_warnings").alias("warnings"))


def is_file_target(target: Column) -> Column:
    return S.hit(target, P.DOCX_EXTERNAL_PATH, "i")


def external_targets(rels: DataFrame) -> DataFrame:
    """External relationships as rows: trimmed target and what it is."""
    target = S.strip(F.col("target"))
    return rels.where(F.lower("target_mode") == "external").select(
        "doc_id",
        "seq",
        target.alias("target"),
        is_file_target(target).alias("is_file"),
        S.hit(target, "^https?://", "i").alias("is_url"),
        F.contains(F.lower("rel_type"), F.lit("attachedtemplate")).alias("is_template"),
    )


def distinct_targets(rels: DataFrame) -> DataFrame:
    """External targets once per document, with how often they occur: a narrow exchange that spreads a hot document."""
    return external_targets(rels).groupBy("doc_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("is_file").alias("is_file"), F.any_value("is_url").alias("is_url"), F.bool_or("is_template").alias("is_template")
    )


def target_measures() -> R.Measures:
    return {
        "external_count": R.total(F.col("n")),
        "file_targets": R.total(F.when(F.col("is_file"), F.col("n")).otherwise(0)),
        "has_file_target": R.any_(F.col("is_file")),
        "has_external_template": R.any_(F.col("is_template")),
        "url_count": R.count_if(F.col("is_url")),
    }


def external_rels(rels: DataFrame) -> DataFrame:
    """Per document: counts and flags of its external relationships; the targets themselves stay rows."""
    return R.rolled(distinct_targets(rels), "doc_id", target_measures())


def hidden_reasons(runs: DataFrame) -> DataFrame:
    """Add the sorted hidden-text reasons of a run; blank runs have none."""
    reasons = S.compacted(
        F.array(
            F.when(F.coalesce("deleted", F.lit(False)), F.lit("deleted-or-field-instruction-text")),
            F.when(F.col("half_points").between(1, 8), F.lit("very-small-font")),
            F.when(F.upper("color").isin(*P.DOCX_WHITE), F.lit("white-or-near-white-font")),
            F.when(F.coalesce("vanish", F.lit(False)), F.lit("word-hidden-text-property")),
            F.when(S.has_zero_width(F.col("text")), F.lit("zero-width-characters")),
        )
    )
    blank = ~S.hit(F.col("text"), "\\S", "U")
    return runs.withColumn("reasons", F.when(blank, F.array().cast("array<string>")).otherwise(reasons))


def inspect_runs(runs: DataFrame) -> DataFrame:
    """Runs with reasons and content signals; a single narrow pass feeds every run operator.

    ``revision`` marks insertions, deletions and moves; field instructions are ``deleted`` without it.
    """
    body = runs if "revision" in runs.columns else runs.withColumn("revision", F.lit(False))
    return (
        hidden_reasons(body.where(S.hit(F.col("part"), P.DOCX_TEXT_PART, "i")))
        .withColumn("signals", S.docx_signals(F.col("text")))
        .withColumn("is_hidden", F.size("reasons") > 0)
    )


def hidden_runs(inspected: DataFrame, limit: int | None = None) -> DataFrame:
    """Hidden runs: all, or for display the first ``limit`` per document in reading order."""
    kept = inspected.where("is_hidden").select("doc_id", "part", "seq", S.normalize(F.col("text")).alias("preview"), "reasons", "signals")
    return kept if limit is None else top_n(kept, ["doc_id"], ["part", "seq"], limit)


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


RUN_INDICATORS = (
    "command-or-script-indicator", "credential-theft-language", "prompt-injection-like-instruction", "zero-width-characters",
)


def run_measures() -> R.Measures:
    """Text length, hidden runs and indicator flags, on inspected runs."""
    hidden = lambda c: F.when(F.col("is_hidden"), c)
    return {
        "text_length": R.total(F.length("text")),
        "hidden_count": R.count_if(F.col("is_hidden")),
        "has_tracked_changes": R.any_(F.coalesce("revision", F.lit(False))),
        "hidden_reasons": R.names(hidden(F.col("reasons"))),
        "hidden_signals": R.names(hidden(F.col("signals"))),
        "hidden_preview": R.first_by(hidden(S.normalize(F.col("text"))), hidden(F.struct("part", "seq"))),
        "hidden_suspicious": R.any_(F.col("is_hidden") & F.arrays_overlap("signals", _texts(P.DOCX_HIDDEN_SIGNALS))),
        "_hidden": R.any_(F.col("is_hidden") & (F.size("signals") > 0)),
        **{f"_i{k}": R.any_(F.array_contains("signals", n)) for k, n in enumerate(RUN_INDICATORS)},
    }


def run_finish(rolled: DataFrame) -> DataFrame:
    """Adds the text limit and the sorted content indicators."""
    shown = [F.when(F.col(f"_i{k}"), F.lit(n)) for k, n in enumerate(RUN_INDICATORS)]
    found = F.array_sort(S.compacted(F.array(*shown, F.when(F.col("_hidden"), F.lit("suspicious-content-in-hidden-text")))))
    out = rolled.withColumns({"text_limit_reached": F.col("text_length") > P.DOCX_MAX_TEXT, "content_indicators": found})
    return out.drop("_hidden", *[f"_i{k}" for k in range(len(RUN_INDICATORS))])


def run_rollup(inspected: DataFrame) -> DataFrame:
    """Text length, hidden runs and indicator flags in one aggregation with small partials."""
    return run_finish(R.rolled(inspected, "doc_id", run_measures()))


def text_stats(runs: DataFrame) -> DataFrame:
    """Text length over body parts, and whether it is above the limit."""
    return run_rollup(inspect_runs(runs)).select("doc_id", "text_length", "text_limit_reached")


def indicators(runs: DataFrame) -> DataFrame:
    """Content indicators of every document with body text."""
    return run_rollup(inspect_runs(runs)).select("doc_id", "content_indicators")


def flags(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Comments from the entry names, tracked changes from the runs."""
    return (
        entry_rollup(entries)
        .select("doc_id", "has_comments")
        .join(run_rollup(inspect_runs(runs)).select("doc_id", "has_tracked_changes"), "doc_id", "left")
        .withColumn("has_tracked_changes", F.coalesce("has_tracked_changes", F.lit(False)))
    )


def facts(entries: DataFrame, runs: DataFrame, rels: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """One facts row per package, with defaults.

    All inputs are already one row per ``doc_id`` and partitioned by it, so the joins add no exchange.
    """
    seen = inspect_runs(runs)
    out = (
        entry_rollup(entries)
        .join(external_rels(rels), "doc_id", "left")
        .join(run_rollup(seen), "doc_id", "left")
    )
    if parts is not None:
        out = out.join(part_warnings(parts).select("doc_id", F.col("warnings").alias("part_warnings")), "doc_id", "left")
    else:
        out = out.withColumn("part_warnings", F.array().cast("array<string>"))
    return out.select("doc_id", *facts_columns())


def facts_columns() -> list[Column]:
    """Facts of a package from its finished measures."""
    none = F.array().cast("array<string>")
    no = lambda c: F.coalesce(c, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    listed = S.compacted(
        F.array(
            F.when(no(F.col("text_limit_reached")), F.lit("text-analysis-limit-reached")),
            F.when(F.col("xml_parts") > P.DOCX_MAX_XML_PARTS, F.lit("xml-part-count-limit-exceeded")),
        )
    )
    supported = F.col("limit_warning").isNull()
    keep = lambda c, empty: F.when(supported, c).otherwise(empty)
    found = F.array_sort(
        F.array_distinct(
            F.concat(
                F.coalesce("content_indicators", none),
                S.compacted(
                    F.array(
                        F.when(no(F.col("has_executable_entry")), F.lit("executable-or-script-like-package-entry")),
                        F.when(F.col("macro_count") > 0, F.lit("macro-related-component-detected")),
                        F.when(F.col("embedded_count") > 0, F.lit("embedded-objects-present")),
                        F.when(no(F.col("has_file_target")), F.lit("external-file-or-network-path")),
                    )
                ),
            )
        )
    )
    warnings = F.array_sort(F.array_distinct(F.concat("entry_warnings", listed, F.coalesce("part_warnings", none))))
    return [
        supported.alias("supported"),
        F.col("limit_warning").alias("error"),
        F.col("entry_count"),
        F.col("uncompressed_size"),
        keep(zero(F.col("text_length")), F.lit(0)).alias("text_length"),
        keep(zero(F.col("hidden_count")), F.lit(0)).alias("hidden_count"),
        keep(F.coalesce("hidden_reasons", none), none).alias("hidden_reasons"),
        keep(F.coalesce("hidden_signals", none), none).alias("hidden_signals"),
        keep(F.coalesce("hidden_preview", F.lit("")), F.lit("")).alias("hidden_preview"),
        keep(no(F.col("hidden_suspicious")), F.lit(False)).alias("hidden_suspicious"),
        keep(zero(F.col("url_count")), F.lit(0)).alias("url_count"),
        keep(zero(F.col("external_count")), F.lit(0)).alias("external_count"),
        keep(zero(F.col("file_targets")), F.lit(0)).alias("file_targets"),
        keep(F.col("embedded_count"), F.lit(0)).alias("embedded_count"),
        keep(no(F.col("embedded_executable")), F.lit(False)).alias("embedded_executable"),
        keep(F.coalesce("embedded_example", F.lit("")), F.lit("")).alias("embedded_example"),
        keep(F.col("macro_count"), F.lit(0)).alias("macro_count"),
        keep(found, none).alias("indicators"),
        F.when(supported, warnings).otherwise(F.array(F.col("limit_warning"))).alias("warnings"),
        keep(no(F.col("has_comments")), F.lit(False)).alias("has_comments"),
        keep(no(F.col("has_tracked_changes")), F.lit(False)).alias("has_tracked_changes"),
        keep(no(F.col("has_external_template")), F.lit(False)).alias("has_external_template"),
    ]


def sources(entries: DataFrame, runs: DataFrame, rels: DataFrame, parts: DataFrame | None, prefix: str) -> list[R.Source]:
    """The tables of packages as sources of one fold, see ``finish``."""
    out = [
        R.Source(entry_warnings(entries), "doc_id", prefix, entry_measures()),
        R.Source(inspect_runs(runs), "doc_id", prefix, run_measures()),
        R.Source(distinct_targets(rels), "doc_id", prefix, target_measures()),
    ]
    if parts is not None:
        out.append(R.Source(parts.where(_is_xml(F.col("name"))), "doc_id", prefix, part_measures()))
    return out


def finish(rolled: DataFrame) -> tuple[DataFrame, Column]:
    """What ``facts_columns`` needs, and whether a row is a package at all."""
    out = run_finish(entry_finish(rolled))
    out = part_finish(out) if "seen_parts" in out.columns else out.withColumn("part_warnings", F.array().cast("array<string>"))
    return out, F.col("entry_count") > 0
