"""Queries on sources, sinks and file identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import query, text
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import identity
from docrisk.session import work_folder
from docrisk.sources import files, sinks, tables

_EXT = r"regexp_extract(lower(filename), '(\.[^.]*)$', 1)"
EXPECTED_SQL = f"case {_EXT} " + " ".join(f"when '{k}' then '{v}'" for k, v in P.EXPECTED_TYPES.items()) + " end"
DETECTED_SQL = (
    "case "
    + " ".join(
        f"when substr(head_hex, {1 + 2 * o}, {len(p)}) = '{p}' then '{t}'"
        for p, o, t, _ in sorted(identity.SIGNATURES, key=lambda s: -len(s[0]))
    )
    + " end"
)


@query("io_read_files", "IO-1", "select doc_id, cast(strlen(text) + 1 as bigint) as size, sha256(text || chr(10)) as sha256 from {documents} where text is not null")
def read_files(x: Inputs) -> DataFrame:
    """Every document landed as a file of its own, read back as bytes and hashed."""
    path = work_folder(x.spark, "files") + "/in"
    # rows that share an id are files of their own: a row's place in the table tells them apart, without a shuffle of texts
    place = [F.md5(F.col("_metadata.file_path").cast("binary")), F.col("_metadata.row_index").cast("string")]
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), *place)
    rows = x.documents.where("text is not null").select(F.concat(name, F.lit(".txt")).alias("filename"), F.concat("text", F.lit("\n")).alias("content"))
    sinks.write_files(rows, path)
    landed = identity.with_sha256(files.read_files(x.spark, path))
    return landed.select(F.regexp_extract("filename", "^(.*)-[0-9a-f]{32}-\\d+\\.txt$", 1).try_cast("bigint").alias("doc_id"), "size", "sha256")


_KINDS = (
    "case when filename like '%.json' then 'json' when filename like '%.docx' then 'docx' "
    "when filename like '%.exe' then 'exe' else 'other' end"
)


@query(
    "io_gate_size", "IO-2",
    f"""with k as (select file_id, {_KINDS} as kind, size * 65536 as bytes from {{fx_files}})
    select file_id, kind, bytes, bytes > case kind when 'json' then {P.JSON_LIMIT} when 'docx' then {P.DOCX_LIMIT}
      when 'exe' then {P.EXE_LIMIT} else {P.UPLOAD_LIMIT} end as oversize from k""",
)
def gate_size(x: Inputs) -> DataFrame:
    sized = x.fx_files.selectExpr("file_id", f"{_KINDS} as kind", "size * 65536 as bytes")
    return files.gate_size(sized, size="bytes").select("file_id", "kind", "bytes", "oversize")


@query("io_texts", "IO-3", "select src, item_id, part, length(text) as n_chars, sha256(text) as sha256 from {fx_texts}")
def texts(x: Inputs) -> DataFrame:
    return identity.with_sha256(tables.texts(x.spark, x.sf_dir), "text").select(
        "src", "item_id", "part", F.length("text").cast("bigint").alias("n_chars"), "sha256"
    )


@query(
    "io_write_scans", "IO-4",
    "select strftime(cast(created_at as date), '%Y-%m-%d') as scan_day, count(*) as scans, cast(sum(risk_score) as bigint) as total from {fx_scans} group by 1",
)
def write_scans(x: Inputs) -> DataFrame:
    path = work_folder(x.spark, "scans") + "/table"
    sinks.write_scans(x.fx_scans, path)
    return (
        x.spark.read.parquet(path)
        .groupBy(F.date_format("scan_date", "yyyy-MM-dd").alias("scan_day"))
        .agg(F.count(F.lit(1)).alias("scans"), F.sum("risk_score").cast("bigint").alias("total"))
    )


@query(
    "io_cap_output", "IO-5",
    """with j as (select doc_id, strlen(to_json(struct_pack(doc_id := doc_id, lang := lang, source := source, n_chars := n_chars))) as output_bytes from {documents})
    select doc_id, output_bytes, output_bytes <= 60 as supported,
      case when output_bytes > 60 then 'output exceeds the limit' end as error from j""",
)
def cap_output(x: Inputs) -> DataFrame:
    rows = x.documents.select("doc_id", "lang", "source", "n_chars")
    return sinks.cap_output(rows, max_bytes=60, keep=("doc_id",)).select("doc_id", "output_bytes", "supported", "error")


@query(
    "io_decode_utf8", "IO-6",
    """select doc_id, doc_id % 5 <> 0 as valid_utf8, case when doc_id % 5 <> 0 then sha256(text) end as text_sha from {documents}""",
)
def decode_utf8(x: Inputs) -> DataFrame:
    raw = x.documents.select(
        "doc_id",
        F.expr(
            "unhex(concat(case when doc_id % 3 = 0 then 'EFBBBF' else '' end, hex(encode(text, 'utf-8')),"
            " case when doc_id % 5 = 0 then 'FF' else '' end))"
        ).alias("content"),
    )
    return files.decode_utf8(raw).select("doc_id", "valid_utf8", F.sha2("text", 256).alias("text_sha"))


@query("id_sha256", "ID-1", "select doc_id, sha256(text) as sha256 from {documents}")
def sha256(x: Inputs) -> DataFrame:
    return identity.with_sha256(x.documents, "text").select("doc_id", "sha256")


@query("id_extension", "ID-2", f"select file_id, {_EXT} as extension from {{fx_files}}")
def extension(x: Inputs) -> DataFrame:
    return x.fx_files.select("file_id", identity.extension(F.col("filename")).alias("extension"))


@query("id_expected_type", "ID-3", f"select file_id, {EXPECTED_SQL} as expected_type from {{fx_files}}")
def expected_type(x: Inputs) -> DataFrame:
    return x.fx_files.select("file_id", identity.expected_type(F.col("filename")).alias("expected_type"))


@query("id_detect_type", "ID-4", f"select file_id, {DETECTED_SQL} as detected_type from {{fx_files}}")
def detect_type(x: Inputs) -> DataFrame:
    return identity.detect_type(x.fx_files).select("file_id", "detected_type")


@query(
    "id_json_fallback", "ID-5",
    r"""with f as (select doc_id, text, doc_id % 3 = 0 as named, case when doc_id % 5 = 0 then 'pdf' end as sig from {fx_json_docs})
    select doc_id, case when sig is null and json_valid(text) and not regexp_matches(text, ',\s*[}}\]]')
      and not regexp_matches(text, ':\s*NaN') and (named or regexp_matches(text, '^\s*[\[{{]')) then 'json' else sig end as detected_type from f""",
)
def json_fallback(x: Inputs) -> DataFrame:
    named = x.fx_json_docs.selectExpr(
        "doc_id", "text", "if(doc_id % 3 = 0, 'a.json', 'a.txt') as filename", "cast(octet_length(text) as bigint) as size",
        "if(doc_id % 5 = 0, 'pdf', null) as detected_type", "cast(null as string) as detected_mime",
    )
    return identity.json_fallback(named).select("doc_id", "detected_type")


@query(
    "id_mismatch", "ID-6",
    f"""with t as (select file_id, {EXPECTED_SQL} as e, {DETECTED_SQL} as d from {{fx_files}})
    select file_id, coalesce(e <> d, false) as extension_mismatch from t""",
)
def mismatch(x: Inputs) -> DataFrame:
    return identity.mismatch(identity.detect_type(x.fx_files)).select("file_id", "extension_mismatch")


@query(
    "id_route", "ID-7",
    rf"""with t as (select file_id, filename, {DETECTED_SQL} as d from {{fx_files}})
    select file_id, coalesce(d = 'pdf', false) as route_pdf,
      coalesce(d = 'exe', false) or regexp_matches(filename, '(?i)\.exe$') as route_exe,
      coalesce(d in ('docx', 'docm'), false) or regexp_matches(filename, '(?i)\.(docx|docm)$') as route_docx,
      coalesce(d = 'json', false) or regexp_matches(filename, '(?i)\.json$') as route_json from t""",
)
def route(x: Inputs) -> DataFrame:
    return identity.route(identity.detect_type(x.fx_files)).select("file_id", "route_pdf", "route_exe", "route_docx", "route_json")


@query(
    "id_double_extension", "ID-8",
    f"select file_id, regexp_matches(filename, {text('(?i)' + identity.DOUBLE_EXTENSION)}) as double_extension from {{fx_files}}",
)
def double_extension(x: Inputs) -> DataFrame:
    return identity.double_extension(x.fx_files).select("file_id", "double_extension")


@query(
    "id_duplicates", "ID-9",
    "select sha256, count(*) as copies, min(file_id) as first_id from {fx_files} group by 1 having count(*) > 1",
)
def duplicates(x: Inputs) -> DataFrame:
    return identity.duplicates(x.fx_files)
