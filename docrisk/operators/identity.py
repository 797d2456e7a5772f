"""What a file is: hash, extension, type by leading bytes, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P

# Our own signature table: (hex prefix, byte offset, type, mime). Longer prefixes win.
SIGNATURES = (
    ("255044462D", 0, "pdf", "application/pdf"),
    ("4D5A", 0, "exe", "application/x-msdownload"),
    ("504B0304", 0, "zip", "application/zip"),
    ("504B0506", 0, "zip", "application/zip"),
    ("89504E470D0A1A0A", 0, "png", "image/png"),
    ("89504E47", 0, "png", "image/png"),
    ("FFD8FF", 0, "jpg", "image/jpeg"),
    ("474946383761", 0, "gif", "image/gif"),
    ("474946383961", 0, "gif", "image/gif"),
    ("57454250", 8, "webp", "image/webp"),
    ("D0CF11E0A1B11AE1", 0, "cfb", "application/x-cfb"),
    ("1F8B08", 0, "gz", "application/gzip"),
    ("377ABCAF271C", 0, "7z", "application/x-7z-compressed"),
    ("526172211A07", 0, "rar", "application/x-rar-compressed"),
    ("7F454C46", 0, "elf", "application/x-elf"),
)

# Double extension: a document suffix followed by one that runs.
DOUBLE_EXTENSION = (
    r"\.(pdf|docx?|xlsx?|pptx?|txt|png|jpe?g|gif|json|html?)"
    r"\.(exe|dll|scr|bat|cmd|ps1|vbs|js|hta|com|msi)$"
)


def with_sha256(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``sha256`` of binary or text content; select it and drop the content before any shuffle."""
    return df.withColumn("sha256", F.sha2(F.col(content), 256))


def extension(name: Column) -> Column:
    """Lower-case text from the last dot on, or an empty string."""
    return F.regexp_extract(F.lower(name), r"(\.[^.]*)$", 1)


def expected_type(name: Column) -> Column:
    """Type the extension promises; null when unknown. A 20-entry literal map, no join."""
    pairs = [F.lit(x) for kv in P.EXPECTED_TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(name))


def signature_match(head_hex: str, signatures=SIGNATURES) -> Column:
    """Struct (type, mime, prefix) of the longest signature the leading bytes carry, else null."""
    tests = " ".join(
        f"when substring(_h, {1 + 2 * offset}, {len(prefix)}) = '{prefix}' then named_struct('type', '{kind}', 'mime', '{mime}', 'prefix', '{prefix}')"
        for prefix, offset, kind, mime in sorted(signatures, key=lambda s: -len(s[0]))
    )
    return F.expr(f"transform(array(upper({head_hex})), _h -> case {tests} end)[0]")


def detect_type(df: DataFrame, head_hex: str = "head_hex", signatures=SIGNATURES) -> DataFrame:
    """Add ``detected_type`` and ``detected_mime`` from the leading bytes written as hex."""
    return (
        df.withColumn("_sig", signature_match(head_hex, signatures))
        .withColumns({"detected_type": F.col("_sig.type"), "detected_mime": F.col("_sig.mime")})
        .drop("_sig")
    )


def json_fallback(df: DataFrame, text: str = "text", name: str = "filename", size: str = "size") -> DataFrame:
    """Call a file JSON when no signature matched and its text parses.

    Names other than ``.json`` must start with a brace or bracket. Repeated keys are accepted, see
    ``spark.sql.variant.allowDuplicateKeys`` in the session defaults.
    """
    body = F.trim(F.regexp_replace(F.col(text), "(?U)^[\\s\\uFEFF]+|\\s+$", ""))
    eligible = (
        F.col("detected_type").isNull()
        & (F.col(size) > 0)
        & (body != "")
        & ((extension(F.col(name)) == ".json") | body.startswith("{") | body.startswith("["))
    )
    is_json = F.coalesce(F.when(eligible, F.try_parse_json(body).isNotNull()), F.lit(False))
    return (
        df.withColumn("_json", is_json)
        .withColumn("detected_type", F.when(F.col("_json"), F.lit("json")).otherwise(F.col("detected_type")))
        .withColumn("detected_mime", F.when(F.col("_json"), F.lit("application/json")).otherwise(F.col("detected_mime")))
        .drop("_json")
    )


def mismatch(df: DataFrame, name: str = "filename") -> DataFrame:
    """Add ``extension_mismatch``: both types known and different."""
    return df.withColumn(
        "extension_mismatch",
        F.coalesce(expected_type(F.col(name)) != F.col("detected_type"), F.lit(False)),
    )


def route(df: DataFrame, name: str = "filename") -> DataFrame:
    """Add four route flags; a file may take several routes."""

    def either(types: tuple[str, ...], suffix: str) -> Column:
        return F.coalesce(F.col("detected_type").isin(*types), F.lit(False)) | F.coalesce(
            F.rlike(F.col(name), F.lit(f"(?i)\\.({suffix})$")), F.lit(False)
        )

    return (
        df.withColumn("route_pdf", F.coalesce(F.col("detected_type") == "pdf", F.lit(False)))
        .withColumn("route_exe", either(("exe",), "exe"))
        .withColumn("route_docx", either(("docx", "docm"), "docx|docm"))
        .withColumn("route_json", either(("json",), "json"))
    )


def double_extension(df: DataFrame, name: str = "filename") -> DataFrame:
    return df.withColumn("double_extension", F.coalesce(F.rlike(F.col(name), F.lit("(?i)" + DOUBLE_EXTENSION)), F.lit(False)))


def duplicates(df: DataFrame, scan_id: str = "file_id") -> DataFrame:
    """Hashes seen more than once: number of copies and the lowest id. Partial aggregation first."""
    return (
        df.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(scan_id).alias("first_id"))
        .where(F.col("copies") > 1)
    )
