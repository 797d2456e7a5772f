"""Rule table and its compiler.

A rule is data: SQL text over the facts columns. The compiler turns a list of rules into one array
expression, so a facts row gets all its evidence in a single narrow pass. A rule that would
repeat per attachment keeps one row with ``occurrences``; scores count every occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P

# Score by severity when a rule names none.
DEFAULT_SCORES = {"low": 2, "medium": 5, "high": 15, "critical": 50}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    when: str
    category: str
    severity: str  # a level, or SQL that yields one
    score: int | str | None
    source: str
    title: str
    detail: str = "''"  # SQL for the description
    occurrences: str = "1"

    def sql(self, described: bool = True) -> str:
        """The rule as ``case when ... then array(named_struct(...)) else array() end``."""
        level = f"'{self.severity}'" if self.severity in DEFAULT_SCORES else self.severity
        score = DEFAULT_SCORES[self.severity] if self.score is None else self.score
        return (
            f"case when {self.when} then array(named_struct('rule_id', '{self.rule_id}', 'category', '{self.category}', "
            f"'title', '{self.title}', 'description', {self.description() if described else "''"}, 'severity', {level}, "
            f"'source', '{self.source}', 'score', cast({score} as int), 'occurrences', cast({self.occurrences} as bigint))) else array() end"
        )

    def description(self) -> str:
        return f"coalesce({self.detail}, '')"


def _in(values: Sequence[str]) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def _joined(col: str) -> str:
    return f"array_join({col}, ', ')"


# Rule ids, categories, sources and scores.
GENERIC = (
    Rule("G-1", "extension_mismatch", "file-type", "high", 15, "magic-byte-analysis", "Name and content disagree",
         "format_string('named %s, content is %s', extension, detected_type)"),
    Rule("G-2", "av_status = 'threat'", "malware", "critical", 50, "clamav", "Malware reported", "av_details"),
    Rule("G-3", "av_status = 'unavailable'", "scanner", "medium", 5, "clamav", "No antivirus verdict"),
)

PDF = (
    Rule("EP-1", "supported and javascript_count > 0", "pdf-security", "high", 20, "pdf-structure-analysis", "JavaScript objects",
         "format_string('%d object(s) with JavaScript', javascript_count)"),
    Rule("EP-2", "supported and action_type = 'GoTo'", "pdf-navigation", "low", 0, "pdf-openaction-analysis", "Opens at a destination"),
    Rule("EP-3", "supported and action_type = 'GoToR'", "pdf-navigation", "medium", 5, "pdf-openaction-analysis", "Opens another document", "action_target"),
    Rule("EP-4", "supported and action_type = 'URI'", "pdf-navigation", "low", 2, "pdf-openaction-analysis", "Opens a URL", "action_target"),
    Rule("EP-5", "supported and action_type = 'JavaScript'", "pdf-security", "high", 20, "pdf-openaction-analysis", "Runs JavaScript on open", "action_target"),
    Rule("EP-6", "supported and action_type = 'Launch'", "pdf-security", "high", 25, "pdf-openaction-analysis", "Starts a program on open", "action_target"),
    Rule("EP-7", "supported and action_type = 'Unknown'", "pdf-security", "medium", 5, "pdf-openaction-analysis", "Unclassified open action", "action_raw_type"),
    Rule("EP-8", "supported and has_additional_actions", "pdf-security", "medium", 10, "pdf-structure-analysis", "Additional actions"),
    Rule("EP-9", "supported and has_launch and not (action_type <=> 'Launch')", "pdf-security", "high", 25, "pdf-structure-analysis", "Launch action"),
    Rule("EP-10", "supported and provenance_count > 0", "pdf-provenance", "low", 0, "pdf-embedded-file-analysis", "Provenance data attached"),
    Rule("EP-11", "supported and executable_attachments > 0", "pdf-security", "high", 25, "pdf-embedded-file-analysis", "Executable-like attachment",
         occurrences="executable_attachments"),
    Rule("EP-12", "supported and other_attachments > 0", "pdf-security", "medium", 5, "pdf-embedded-file-analysis", "Attachment",
         occurrences="other_attachments"),
    Rule("EP-13", "supported and has_rich_media", "pdf-security", "medium", 10, "pdf-structure-analysis", "Rich media"),
    Rule("EP-14", "supported and has_xfa", "pdf-security", "medium", 8, "pdf-structure-analysis", "XFA form"),
    Rule("EP-15", "supported and url_count > 0", "pdf-links", "low", 2, "pdf-link-analysis", "Links", "format_string('%d distinct URL(s)', url_count)"),
    Rule("EP-16", "supported and text_source = 'ocr' and ocr_attempted and ocr_available", "pdf-text", "low", 2, "pdf-ocr", "Text read by OCR",
         "format_string('%d page(s)', ocr_page_count)"),
    Rule("EP-17", "supported and ocr_attempted and not ocr_available", "pdf-text", "medium", 5, "pdf-ocr", "OCR needed, not available"),
    Rule("EP-18", "supported and ocr_attempted and ocr_available and ocr_errors > 0", "pdf-text", "medium", 4, "pdf-ocr", "OCR incomplete",
         "format_string('%d problem(s)', ocr_errors)"),
    Rule("EP-19", "supported and form_field_count > 0", "pdf-forms", "low", 1, "pdf-structure-analysis", "Form fields",
         "format_string('%d field(s)', form_field_count)"),
    Rule("EP-20", "supported and has_acroform", "pdf-forms", "low", 1, "pdf-structure-analysis", "AcroForm"),
    Rule("EP-21", "supported and hidden_count > 0", "pdf-hidden-text", "if(hidden_suspicious, 'high', 'medium')", "if(hidden_suspicious, 20, 8)",
         "pdf-hidden-text-analysis", "Hidden text",
         "format_string('%d span(s); signals: %s; content: %s; example: %s', hidden_count, "
         "array_join(hidden_reasons, ', '), array_join(hidden_signals, ', '), hidden_preview)"),
)

EXE = (
    Rule("X-1", "not supported", "exe-structure", "high", 18, "exe-static-analysis", "Structure not valid", "error"),
    Rule("X-2", "supported and size(structural_warnings) > 0", "exe-structure", "high", 18, "exe-structure-validation", "Structure warnings",
         "array_join(structural_warnings, ', ')"),
    Rule("X-3", "supported and sensitive_import_count > 0", "exe-imports", "if(has_injection_import, 'high', 'medium')",
         "if(sensitive_import_count >= 3, 18, 10)", "exe-import-analysis", "Sensitive imports",
         "format_string('%d import(s): %s', sensitive_import_count, array_join(sensitive_imports, ', '))"),
    Rule("X-4", "supported and size(indicators) > 0", "exe-strings",
         "if(array_contains(indicators, 'process-injection-api'), 'high', 'medium')",
         "if(array_contains(indicators, 'process-injection-api'), 15, 8)", "exe-string-analysis", "Behaviour strings",
         "array_join(indicators, ', ')"),
    Rule("X-5", "supported and (size(urls) > 0 or size(ip_addresses) > 0)", "exe-network", "low", 3, "exe-string-analysis", "Network strings",
         "format_string('%d URL(s), %d address(es)', size(urls), size(ip_addresses))"),
    Rule("X-6", "supported and size(high_entropy_sections) > 0", "exe-packing", "medium", 8, "exe-section-analysis", "High-entropy sections",
         "array_join(high_entropy_sections, ', ')"),
    Rule("X-7", "supported and size(writable_executable_sections) > 0", "exe-sections", "medium", 8, "exe-section-analysis",
         "Writable and executable section", "array_join(writable_executable_sections, ', ')"),
    Rule("X-8", "supported and not has_certificate", "exe-signature", "low", 2, "exe-signature-presence-check", "No certificate table"),
    Rule("X-9", "supported and overlay_size > 1024", "exe-overlay", "low", 3, "exe-structure-analysis", "Data after the last section",
         "format_string('%d byte(s)', overlay_size)"),
    Rule("X-10", "supported and (section_count = 0 or entry_point = 0)", "exe-structure", "high", 15, "exe-structure-analysis",
         "No sections or no entry point"),
)

DOCX = (
    Rule("OD-1", "not supported", "docx-analysis", "high", 20, "docx-static-analysis", "Analysis incomplete", "error"),
    Rule("OD-2", "supported and size(warnings) > 0", "docx-package",
         f"if(arrays_overlap(warnings, {_in(P.DOCX_SEVERE_WARNINGS)}), 'high', 'medium')",
         f"if(arrays_overlap(warnings, {_in(P.DOCX_SEVERE_WARNINGS)}), 18, 7)", "docx-package-analysis", "Package warnings",
         _joined("warnings")),
    Rule("OD-3", "supported and hidden_count > 0", "docx-hidden-content", "if(hidden_suspicious, 'high', 'medium')", "if(hidden_suspicious, 22, 8)",
         "docx-hidden-text-analysis", "Hidden runs",
         "format_string('%d run(s); formatting: %s; content: %s; examples: %s', hidden_count, array_join(hidden_reasons, ', '), "
         "array_join(hidden_signals, ', '), hidden_preview)"),
    Rule("OD-4", "supported and url_count > 0", "docx-links", "low", 2, "docx-relationship-analysis", "Links", "format_string('%d URL(s)', url_count)"),
    Rule("OD-5", "supported and file_targets > 0", "docx-external-content", "high", 18, "docx-relationship-analysis", "External file or network path",
         "format_string('%d target(s)', file_targets)"),
    Rule("OD-6", "supported and has_external_template", "docx-external-content", "medium", 8, "docx-relationship-analysis", "External template"),
    Rule("OD-7", "supported and embedded_count > 0", "docx-embedded-content", "if(embedded_executable, 'high', 'medium')",
         "if(embedded_executable, 25, 6)", "docx-embedded-object-analysis", "Embedded objects",
         "format_string('%d object(s), first: %s', embedded_count, embedded_example)"),
    Rule("OD-8", "supported and macro_count > 0", "docx-macros", "high", 20, "docx-package-analysis", "Macro project",
         "format_string('%d part(s)', macro_count)"),
    Rule("OD-9", f"supported and arrays_overlap(indicators, {_in(P.DOCX_REPORTED_INDICATORS)})", "docx-content-indicators", "high", 15,
         "docx-content-analysis", "Content indicators", _joined(f"array_intersect(indicators, {_in(P.DOCX_REPORTED_INDICATORS)})")),
    Rule("OD-10", "supported and has_tracked_changes", "docx-document-structure", "low", 1, "docx-xml-analysis", "Tracked changes"),
    Rule("OD-11", "supported and has_comments", "docx-document-structure", "low", 1, "docx-xml-analysis", "Comments"),
    Rule("OD-12", "supported and text_length = 0", "docx-content", "medium", 5, "docx-xml-analysis", "No readable text"),
)

_LIMITS = ("node-limit-exceeded", "nesting-depth-limit-exceeded", "string-count-limit-exceeded", "analysis-truncated")
_RUNS = ("shell-command-pattern", "dynamic-code-pattern", "encoded-payload-marker")


def _json(rule_id: str, when: str, severity: str, score: int, title: str, detail: str = "''") -> Rule:
    return Rule(rule_id, when, "json-analysis", severity, score, "json-static-analysis", title, detail)


JSON = (
    _json("EJ-1", "not supported", "medium", 10, "Analysis incomplete", "error"),
    _json("EJ-2", "supported and duplicate_key_count > 0", "medium", 8, "Repeated keys", "format_string('%d repeat(s)', duplicate_key_count)"),
    _json("EJ-3", "supported and injection_count > 0", "high", 20, "Injection-like instructions", "array_join(injection_types, ', ')"),
    _json("EJ-4", "supported and dangerous_key_count > 0", "medium", 10, "Command-like keys", "format_string('%d key(s)', dangerous_key_count)"),
    _json("EJ-5", "supported and size(secret_kinds) > 0", "high", 25, "Secret material", "array_join(secret_kinds, ', ')"),
    _json("EJ-6", "supported and sensitive_key_count > 0", "low", 3, "Sensitive keys", "format_string('%d key(s)', sensitive_key_count)"),
    _json("EJ-7", "supported and html_like_count > 0", "medium", 10, "Script-like strings", "format_string('%d string(s)', html_like_count)"),
    _json("EJ-8", f"supported and arrays_overlap(indicators, {_in(_RUNS)})", "high", 20, "Executable content"),
    # Kept for completeness: a truncated analysis is unsupported, so EJ-1 always comes first.
    _json("EJ-9", f"supported and arrays_overlap(indicators, {_in(_LIMITS)})", "medium", 10, "Safety limit reached"),
)

RULES = {"generic": GENERIC, "pdf": PDF, "exe": EXE, "docx": DOCX, "json": JSON}
EVIDENCE = (
    "array<struct<rule_id:string,category:string,title:string,description:string,severity:string,"
    "source:string,score:int,occurrences:bigint>>"
)


def compiled(rules: Sequence[Rule], described: bool = True) -> Column:
    """Evidence array of a facts row, parsed from one SQL text; no lambda, so it stays in generated code.

    Descriptions cost more than the rules; without ``described`` they are empty.
    """
    return F.expr("concat(" + ", ".join(r.sql(described) for r in rules) + ")").cast(EVIDENCE)


def with_evidence(facts: DataFrame, rules: Sequence[Rule], out: str = "evidence", described: bool = True) -> DataFrame:
    return facts.withColumn(out, compiled(rules, described))


def explode(df: DataFrame, scan_id: str, evidence: str = "evidence") -> DataFrame:
    """Evidence rows with a stable id: the same scan and rule give the same id on every run."""
    # The outer form keeps Spark from deriving a filter that repeats the whole rule expression.
    rows = df.select(F.col(scan_id), F.inline_outer(evidence)).where(F.col("rule_id").isNotNull())
    ident = F.sha2(F.concat_ws("/", F.col(scan_id).cast("string"), F.col("rule_id")), 256)
    return rows.withColumn("evidence_id", ident)


def apply_rules(facts: DataFrame, rules: Sequence[Rule], scan_id: str) -> DataFrame:
    """Facts to evidence rows, without a shuffle. A description is made on its own row, and only if it is read."""
    rows = facts.withColumn("_ev", F.explode_outer(compiled(rules, described=False))).where(F.col("_ev").isNotNull())
    cases = " ".join(f"when '{r.rule_id}' then {r.description()}" for r in rules)
    fields = [F.col(f"_ev.{c}").alias(c) for c in ("rule_id", "category", "title", "severity", "source", "score", "occurrences")]
    fields.insert(3, F.expr(f"case _ev.rule_id {cases} end").alias("description"))
    ident = F.sha2(F.concat_ws("/", F.col(scan_id).cast("string"), F.col("_ev.rule_id")), 256)
    return rows.select(scan_id, *fields, ident.alias("evidence_id"))


def attachment_rows(attachments: DataFrame, scan_id: str = "doc_id") -> DataFrame:
    """Attachment evidence one row each, for reports that name every file.

    Provenance data gives one row per document: the lowest xref, found by a partial aggregate.
    """
    each = attachments.where(~F.col("is_provenance")).select(
        scan_id, "xref", F.when(F.col("is_executable"), F.lit("EP-11")).otherwise(F.lit("EP-12")).alias("rule_id"), "attachment_name", "mime_type"
    )
    one = (
        attachments.where("is_provenance")
        .groupBy(scan_id)
        .agg(F.min_by(F.struct("xref", "attachment_name", "mime_type"), "xref").alias("a"))
        .select(scan_id, "a.xref", F.lit("EP-10").alias("rule_id"), "a.attachment_name", "a.mime_type")
    )
    scores = F.create_map(*[F.lit(x) for r in PDF if r.rule_id in ("EP-10", "EP-11", "EP-12") for x in (r.rule_id, r.score)])
    levels = F.create_map(*[F.lit(x) for r in PDF if r.rule_id in ("EP-10", "EP-11", "EP-12") for x in (r.rule_id, r.severity)])
    named = F.concat(F.coalesce("attachment_name", F.lit("unknown file")), F.lit(" ("), F.coalesce("mime_type", F.lit("unknown type")), F.lit(")"))
    return each.unionByName(one).select(
        scan_id, "xref", "rule_id", F.element_at(levels, F.col("rule_id")).alias("severity"),
        F.element_at(scores, F.col("rule_id")).alias("score"), named.alias("description"),
    )
