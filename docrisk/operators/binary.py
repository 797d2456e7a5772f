"""Executables: headers, sections, imports and printable strings.

A file's sections are packed into one array per file (the header's 16-bit count bounds it), so section
rules, range lookups and overlap tests are expressions on that array instead of range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P
from docrisk.functions import signals as S
from docrisk.functions.checks import byte_entropy
from docrisk.functions.skew import let
from docrisk.operators import rollup as R

X86, X64 = 267, 523  # optional header magic 0x10B and 0x20B
ARCHITECTURES = {"x86": (0x014C,), "x64": (0x8664, 0x0200), "arm64": (0xAA64,)}
EXECUTE, READ, WRITE = 0x20000000, 0x40000000, 0x80000000


def strings(df: DataFrame, content: str = "content", out: str = "strings") -> DataFrame:
    """Add printable runs: ASCII of 5 and more, then UTF-16LE; trimmed, distinct in order of first sight."""
    raw = F.decode(F.col(content), "ISO-8859-1")
    ascii_runs = F.regexp_extract_all(raw, F.lit("[\\x20-\\x7e]{5,}"), 0)
    wide_runs = F.transform(
        F.regexp_extract_all(raw, F.lit("(?:[\\x20-\\x7e]\\x00){5,}"), 0), lambda s: F.replace(s, F.lit("\x00"), F.lit(""))
    )
    trimmed = F.transform(F.concat(ascii_runs, wide_runs), lambda s: F.trim(s))
    return df.withColumn(out, F.array_distinct(F.filter(trimmed, lambda s: s != "")))


def entropy(df: DataFrame, content: str = "content", out: str = "entropy") -> DataFrame:
    return df.withColumn(out, byte_entropy(F.col(content)))


def behaviours(df: DataFrame, strings_col: str = "strings") -> DataFrame:
    """Add behaviour labels and network indicators of the joined strings."""
    joined = F.array_join(strings_col, "\n")
    return (
        df.withColumn("_joined", joined)
        .withColumn("indicators", S.behaviours(F.col("_joined")))
        .withColumn("urls", S.urls(F.col("_joined"), "exe"))
        .withColumn("ip_addresses", S.ipv4(F.col("_joined"), ordered=True))
        .drop("_joined")
    )


def section_flags(sections: DataFrame) -> DataFrame:
    bit = lambda m: F.col("characteristics").cast("bigint").bitwiseAND(F.lit(m).cast("bigint")) != 0
    return (
        sections.withColumn("executable", bit(EXECUTE)).withColumn("readable", bit(READ)).withColumn("writable", bit(WRITE))
    )


def high_entropy(sections: DataFrame) -> DataFrame:
    return sections.where((F.col("entropy") >= P.EXE_ENTROPY) & (F.col("raw_size") >= P.EXE_ENTROPY_SIZE))


SECTION_COLUMNS = ("name", "va", "vsize", "raw_ptr", "raw_size", "entropy", "executable", "readable", "writable")


def section_measures() -> R.Measures:
    """All sections of a file in table order; the header's 16-bit count bounds them."""
    return {"sections": R.Measure(F.struct("idx", *SECTION_COLUMNS), lambda c: F.array_sort(F.collect_list(c)))}


def pack_sections(sections: DataFrame) -> DataFrame:
    """(file_id, section_count, sections): all sections of a file in table order."""
    return R.rolled(section_flags(sections), "file_id", section_measures()).withColumn("section_count", F.size("sections"))


def _end(s: Column) -> Column:
    return (s["raw_ptr"] + s["raw_size"]).cast("bigint")


def overlaps(packed: DataFrame) -> DataFrame:
    """Add ``overlapping``: sorted raw ranges where one starts before the highest end so far."""
    ranges = F.array_sort(
        F.transform(
            F.filter("sections", lambda s: s["raw_size"] > 0),
            lambda s: F.struct(s["raw_ptr"].cast("bigint").alias("start"), _end(s).alias("end")),
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(False).alias("hit"))
    folded = F.aggregate(
        ranges,
        start,
        lambda acc, r: F.struct(
            F.greatest(acc["reach"], r["end"]).alias("reach"), (acc["hit"] | (r["start"] < acc["reach"])).alias("hit")
        ),
    )
    return packed.withColumn("overlapping", folded["hit"])


def raw_ranges_valid(packed: DataFrame, size: str = "file_size") -> DataFrame:
    ok = lambda s: (s["raw_size"] == 0) | (_end(s) <= F.col(size))
    return packed.withColumn("raw_ranges_valid", F.forall("sections", ok))


def entry_point(packed: DataFrame, entry: str = "entry_point") -> DataFrame:
    """Add ``entry_outside``: a non-zero entry point that no executable section covers."""
    covers = lambda s: s["executable"] & (F.col(entry) >= s["va"]) & (
        F.col(entry) < s["va"] + F.greatest(s["vsize"], s["raw_size"])
    )
    return packed.withColumn("entry_outside", (F.col(entry) != 0) & ~F.coalesce(F.exists("sections", covers), F.lit(False)))


def rva_to_offset(packed: DataFrame, rva: str, size: str = "file_size", out: str = "file_offset", header_end: str | None = None) -> DataFrame:
    """Add the file offset of a virtual address: the first section in table order that maps it.

    An address no section maps lies in the headers if it is below ``header_end``, and is its own offset.
    """
    mapped = lambda s: F.least(F.when(s["vsize"] > 0, s["vsize"]).otherwise(s["raw_size"]), s["raw_size"])
    inside = F.filter("sections", lambda s: (F.col(rva) >= s["va"]) & (F.col(rva) < s["va"] + mapped(s)))

    def offset(s: Column) -> Column:
        found = (F.col(rva) - s["va"] + s["raw_ptr"]).cast("bigint")
        return F.when((s["raw_ptr"] <= F.col(size)) & (found < F.col(size)), found)

    in_header = F.lit(None).cast("bigint")
    if header_end:
        below = (F.size(inside) == 0) & (F.col(rva) >= 0) & (F.col(rva) < F.least(F.col(header_end), F.col(size)))
        in_header = F.when(below, F.col(rva).cast("bigint"))
    return packed.withColumn(out, F.coalesce(let(F.get(inside, F.lit(0)), offset), in_header))


def overlay(packed: DataFrame, size: str = "file_size", header_end: str | None = None) -> DataFrame:
    """Add ``overlay_size``: bytes after the last section end, never below 0."""
    last = F.coalesce(F.array_max(F.transform("sections", _end)), F.lit(0).cast("bigint"))
    if header_end:
        last = F.greatest(last, F.col(header_end))
    return packed.withColumn("overlay_size", F.greatest(F.lit(0), F.col(size) - F.least(last, F.col(size))).cast("bigint"))


def certificate(headers: DataFrame) -> DataFrame:
    return headers.withColumn(
        "has_certificate",
        (F.col("cert_offset") > 0) & (F.col("cert_size") > 0) & (F.col("cert_offset") + F.col("cert_size") <= F.col("file_size")),
    )


def header_status(headers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``architecture`` and ``header_error``; the first failing check gives the reason.

    Checks on columns the table lacks (PE signature, section count, header sizes) are skipped; ``columns`` names
    those of the header where the rows have others, too.
    """
    have = set(columns or headers.columns)
    arch = (
        F.when(F.col("magic") == X86, F.lit("x86"))
        .when((F.col("magic") == X64) & (F.col("machine") == 0xAA64), F.lit("arm64"))
        .when(F.col("magic") == X64, F.lit("x64"))
    )
    fits = F.lit(False)
    for name, machines in ARCHITECTURES.items():
        fits = fits | ((F.col("architecture") == name) & F.col("machine").isin(*machines))
    checks: list[tuple[Column, str]] = []
    if "has_mz" in have:
        checks.append((~F.col("has_mz"), "no MZ header"))
    if "has_pe" in have:
        checks.append((~F.col("has_pe"), "no PE signature"))
    if "section_count" in have:
        checks.append(((F.col("section_count") == 0) | (F.col("section_count") > P.EXE_MAX_SECTIONS), "malformed header"))
    checks.append((F.col("architecture").isNull(), "unsupported optional header"))
    checks.append((~fits, "machine conflicts with optional header"))
    if "optional_size" in have:
        checks.append(
            (F.col("optional_size") < F.when(F.col("magic") == X86, 96).otherwise(112), "optional header too small")
        )
    reason: Column = F.when(checks[0][0], F.lit(checks[0][1]))
    for cond, text in checks[1:]:
        reason = reason.when(cond, F.lit(text))
    return headers.withColumn("architecture", arch).withColumn("header_error", reason)


def imports(rows: DataFrame) -> DataFrame:
    """Number of imported functions per file and DLL; the functions themselves stay rows."""
    return rows.groupBy("file_id", "dll").agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("function").alias("distinct_functions"))


def sensitive_imports(rows: DataFrame) -> DataFrame:
    """Imports on the fixed list of 28 names: an in-set test, no join."""
    return rows.where(F.lower("function").isin(*P.SENSITIVE_APIS))


def import_measures() -> R.Measures:
    """Counts of imports, and those on the fixed lists."""
    name = F.lower("function")
    named = name.isin(*P.SENSITIVE_APIS)
    return {
        "import_count": R.rows(),
        "sensitive_import_count": R.count_if(named),
        "has_injection_import": R.any_(named & name.isin(*P.INJECTION_APIS)),
        "sensitive_imports": R.Measure(F.when(named, name), lambda c: F.array_sort(F.collect_set(c))),  # names of the fixed list
    }


def facts(headers: DataFrame, sections: DataFrame, import_rows: DataFrame, string_facts: DataFrame | None = None) -> DataFrame:
    """One facts row per executable. ``string_facts``: file_id, indicators, urls, ip_addresses."""
    out = headers.join(pack_sections(sections), "file_id", "left").join(R.rolled(import_rows, "file_id", import_measures()), "file_id", "left")
    if string_facts is not None:
        out = out.join(string_facts, "file_id", "left")
    return checked(out, headers.columns).select("file_id", *facts_columns(headers.columns))


def checked(out: DataFrame, header_columns: list[str]) -> DataFrame:
    """Adds what the header and the packed sections tell; ``out`` has the header's columns and the measures."""
    none = F.array().cast("array<string>")
    for name in ("indicators", "urls", "ip_addresses"):
        if name not in out.columns:
            out = out.withColumn(name, none)
    sections = F.coalesce("sections", F.array().cast(out.schema["sections"].dataType))
    base = out.withColumn("sections", sections).withColumn("section_count", F.size("sections"))
    header_end = "header_end" if "header_end" in header_columns else None
    return overlay(entry_point(raw_ranges_valid(overlaps(certificate(header_status(base, [*header_columns, "section_count"]))))), header_end=header_end)


def facts_columns(header_columns: list[str]) -> list[Column]:
    """Facts of an executable from its checked header, sections and measures."""
    none = F.array().cast("array<string>")
    optional = lambda c: (F.col(c) if c in header_columns else F.lit(None).cast("bigint")).alias(c)
    ok = F.col("header_error").isNull()
    keep = lambda c, empty: F.when(ok, c).otherwise(empty)
    names = lambda cond: F.transform(F.filter("sections", cond), lambda s: s["name"])
    warnings = S.compacted(
        F.array(
            F.when(F.col("entry_outside"), F.lit("entry-point-not-in-executable-section")),
            F.when(F.col("overlapping"), F.lit("overlapping-section-raw-ranges")),
            F.when(~F.col("raw_ranges_valid"), F.lit("section-raw-range-out-of-bounds")),
        )
    )
    return [
        ok.alias("supported"),
        F.col("header_error").alias("error"),
        F.col("architecture"),
        *[optional(c) for c in ("machine", "subsystem", "image_base")],
        F.col("file_size"),
        F.col("entry_point"),
        keep(F.col("section_count"), F.lit(0)).alias("section_count"),
        keep(warnings, none).alias("structural_warnings"),
        keep(F.coalesce("import_count", F.lit(0)), F.lit(0)).alias("import_count"),
        keep(F.coalesce("sensitive_imports", none), none).alias("sensitive_imports"),
        keep(F.coalesce("sensitive_import_count", F.lit(0)), F.lit(0)).alias("sensitive_import_count"),
        keep(F.coalesce("has_injection_import", F.lit(False)), F.lit(False)).alias("has_injection_import"),
        keep(F.coalesce("indicators", none), none).alias("indicators"),
        keep(F.coalesce("urls", none), none).alias("urls"),
        keep(F.coalesce("ip_addresses", none), none).alias("ip_addresses"),
        keep(names(lambda s: (s["entropy"] >= P.EXE_ENTROPY) & (s["raw_size"] >= P.EXE_ENTROPY_SIZE)), none).alias("high_entropy_sections"),
        keep(names(lambda s: s["executable"] & s["writable"]), none).alias("writable_executable_sections"),
        keep(F.col("has_certificate"), F.lit(False)).alias("has_certificate"),
        keep(F.col("overlay_size"), F.lit(0)).alias("overlay_size"),
    ]


def sources(headers: DataFrame, sections: DataFrame, import_rows: DataFrame, string_facts: DataFrame | None, prefix: str) -> list[R.Source]:
    """The tables of executables as sources of one fold, see ``checked``."""
    out = [
        R.Source(headers, "file_id", prefix, {"header_count": R.rows()} | {c: R.only(F.col(c)) for c in headers.columns if c != "file_id"}),
        R.Source(section_flags(sections), "file_id", prefix, section_measures()),
        R.Source(import_rows, "file_id", prefix, import_measures()),
    ]
    if string_facts is not None:
        out.append(R.Source(string_facts, "file_id", prefix, {c: R.only(F.col(c)) for c in ("indicators", "urls", "ip_addresses")}))
    return out
