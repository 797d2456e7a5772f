"""Text signals as Catalyst columns.

Every pattern is a literal, so Spark compiles it once per task. ``(?iUd)`` gives the usual Unicode
reading of ``\\s \\w \\b`` with a dot that stops only at a line feed; ``s`` lets the dot pass it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P

ZERO_WIDTH_CLASS = "[" + P.ZERO_WIDTH + "]"
TAG_CLASS = "[\\x{E0000}-\\x{E007F}]"
VISIBLE_TOKENS = {
    "\u200b": "[ZWSP]", "\u200c": "[ZWNJ]", "\u200d": "[ZWJ]", "\u2060": "[WJ]", "\ufeff": "[BOM]",
}


def hit(text: Column, pattern: str, flags: str = "iUd") -> Column:
    """True where the pattern occurs; null text counts as no hit."""
    return F.coalesce(F.rlike(text, F.lit(f"(?{flags}){pattern}")), F.lit(False))


def any_hit(text: Column, family: tuple[str, ...], flags: str = "iUd") -> Column:
    """One alternation instead of a chain of scans: only the fact of a match is needed.

    A leading word boundary shared by all patterns is tested once per position.
    """
    if all(p.startswith("\\b") for p in family):
        return hit(text, "\\b(?:" + "|".join(p[2:] for p in family) + ")", flags)
    return hit(text, "(?:" + "|".join(family) + ")", flags)


def compacted(names: Column) -> Column:
    """Array of names without nulls and repeats.

    Unlike ``array_compact``, a lambda that Spark interprets row by row, this stays in generated code,
    so a text normalised for several tests is normalised once.
    """
    return F.array_except(names, F.array(F.lit(None).cast("string")))


def present(*names: Column) -> Column:
    return compacted(F.array(*names))


def normalize(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def compare_form(text: Column) -> Column:
    """Lower case, no zero-width characters, other than a-z and 0-9 become one blank."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), P.ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Tokens of the compare form, repeats kept."""
    return F.filter(F.split(compare_form(text), " "), lambda t: t != "")


def overlap_tokens(text: Column) -> Column:
    """Distinct tokens of at least two characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 2))


def token_overlap(native: Column, visible: Column) -> Column:
    """Share of the native token set that the visible token set also holds; 0 for an empty set."""
    return F.coalesce(
        F.when(F.size(native) > 0, F.size(F.array_intersect(native, visible)) / F.size(native)), F.lit(0.0)
    )


def has_zero_width(text: Column) -> Column:
    return hit(text, ZERO_WIDTH_CLASS, "d")


def zero_width_chars(text: Column) -> Column:
    """Distinct zero-width characters in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ZERO_WIDTH_CLASS), 0))


def has_tag_chars(text: Column) -> Column:
    return hit(text, TAG_CLASS, "d")


def visible_form(text: Column) -> Column:
    """Invisible characters written as tokens such as ``[ZWSP]``; tag characters as ``[TAG]``."""
    out = text
    for char, token in VISIBLE_TOKENS.items():
        out = F.replace(out, F.lit(char), F.lit(token))
    return F.regexp_replace(out, TAG_CLASS, "[TAG]")


def invisible(text: Column) -> Column:
    return F.struct(
        zero_width_chars(text).alias("zero_width"),
        has_tag_chars(text).alias("has_tags"),
        visible_form(text).alias("visible"),
    )


def _kinds(text: Column, family: dict[str, str], flags: str) -> Column:
    """Sorted names of the patterns that occur."""
    names = sorted(family)
    return present(*[F.when(hit(text, family[n], flags), F.lit(n)) for n in names])


def injection_types(text: Column) -> Column:
    return _kinds(text, P.INJECT_JSON, "iUd")


def secret_kinds(text: Column) -> Column:
    return _kinds(text, P.SECRETS, "Ud")


def executable_kinds(text: Column) -> Column:
    return _kinds(text, P.EXEC_JSON, "iUd")


def html_like(text: Column) -> Column:
    return hit(text, f"(?:{P.HTML_LIKE})", "isU")


def behaviours(text: Column) -> Column:
    """Behaviour labels in list order."""
    return present(*[F.when(hit(text, p), F.lit(n)) for n, p in P.BEHAVIOURS.items()])


def docx_signals(text: Column) -> Column:
    """Sorted content signals of a word-processor run."""
    flat = F.lower(normalize(text))
    return present(
        F.when(any_hit(flat, P.COMMAND_DOCX, "isU"), F.lit("command-or-script-indicator")),
        F.when(hit(text, P.URL_DOCX), F.lit("contains-url")),
        F.when(any_hit(flat, P.CREDENTIAL_DOCX, "isU"), F.lit("credential-theft-language")),
        F.when(any_hit(flat, P.INJECT_DOCX, "isU"), F.lit("prompt-injection-like-instruction")),
        F.when(has_zero_width(text), F.lit("zero-width-characters")),
    )


def pdf_signals(text: Column) -> Column:
    """Sorted content signals of a page span."""
    flat = normalize(text)
    return present(
        F.when(any_hit(flat, P.COMMAND_PDF), F.lit("command-execution")),
        F.when(hit(text, P.URL_PDF), F.lit("contains-url")),
        F.when(any_hit(flat, P.CREDENTIAL_PDF), F.lit("credential-request")),
        F.when(any_hit(flat, P.OBFUSCATION_PDF), F.lit("possible-obfuscation")),
        F.when(any_hit(flat, P.INJECT_PDF), F.lit("prompt-injection")),
        F.when(has_zero_width(text), F.lit("zero-width-characters")),
    )


# Hint order follows the signal order below; each signal gives one hint.
HINTS = (
    ("prompt-injection", "high"),
    ("command-execution", "high"),
    ("credential-request", "high"),
    ("possible-obfuscation", "medium"),
    ("contains-url", "low"),
)


def risk_hints(signals: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.array_contains(signals, s), F.lit(level)) for s, level in HINTS])
    )


def urls(text: Column, variant: str) -> Column:
    """URL lists: ``json`` first-seen distinct, ``exe`` and ``pdf`` sorted distinct, ``docx`` as found."""
    found = {
        "json": lambda: F.array_distinct(
            F.filter(
                F.transform(
                    F.regexp_extract_all(text, F.lit("(?iUd)" + P.URL_JSON), 0),
                    lambda u: F.rtrim(u, F.lit(P.URL_JSON_TAIL)),
                ),
                lambda u: u != "",
            )
        ),
        "exe": lambda: F.array_sort(
            F.array_distinct(
                F.transform(
                    F.regexp_extract_all(text, F.lit("(?iUd)" + P.URL_EXE), 0),
                    lambda u: F.rtrim(u, F.lit(P.URL_EXE_TAIL)),
                )
            )
        ),
        "pdf": lambda: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?iUd)" + P.URL_PDF), 0))),
        "docx": lambda: F.regexp_extract_all(text, F.lit("(?iUd)" + P.URL_DOCX), 0),
    }
    return found[variant]()


def redact_url(url: Column) -> Column:
    """Hide credentials and everything after ``?`` or ``#``."""
    no_user = F.regexp_replace(url, "(?i)(https?://)[^/@\\s]+@", "$1[redacted]@")
    tail = F.when(F.contains(no_user, F.lit("?")), F.lit("?[redacted]")).otherwise(F.lit("#[redacted]"))
    return F.regexp_replace(no_user, F.lit("[?#].*$"), tail)


def ipv4(text: Column, ordered: bool = False) -> Column:
    """Distinct addresses whose four parts are at most 255; first-seen order, or sorted."""
    found = F.array_distinct(
        F.filter(
            F.regexp_extract_all(text, F.lit("(?d)" + P.IPV4), 0),
            lambda a: F.forall(F.split(a, "\\."), lambda part: part.cast("int") <= 255),
        )
    )
    return F.array_sort(found) if ordered else found


FAMILIES = {
    "inject_json": injection_types,
    "exec_json": executable_kinds,
    "secret": secret_kinds,
    "inject_docx": lambda t: _one(any_hit(F.lower(normalize(t)), P.INJECT_DOCX, "isU"), "prompt-injection-like-instruction"),
    "command_docx": lambda t: _one(any_hit(F.lower(normalize(t)), P.COMMAND_DOCX, "isU"), "command-or-script-indicator"),
    "credential_docx": lambda t: _one(any_hit(F.lower(normalize(t)), P.CREDENTIAL_DOCX, "isU"), "credential-theft-language"),
    "inject_pdf": lambda t: _one(any_hit(normalize(t), P.INJECT_PDF), "prompt-injection"),
    "command_pdf": lambda t: _one(any_hit(normalize(t), P.COMMAND_PDF), "command-execution"),
    "credential_pdf": lambda t: _one(any_hit(normalize(t), P.CREDENTIAL_PDF), "credential-request"),
    "obfuscation": lambda t: _one(any_hit(normalize(t), P.OBFUSCATION_PDF), "possible-obfuscation"),
    "html": lambda t: _one(html_like(t), "html-or-script-like"),
}


def _one(flag: Column, name: str) -> Column:
    return present(F.when(flag, F.lit(name)))


def with_signals(df: DataFrame, text_col: str, family: str, out: str = "signals") -> DataFrame:
    """Add the sorted signal names of one family."""
    return df.withColumn(out, FAMILIES[family](F.col(text_col)))
