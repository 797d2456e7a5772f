"""JSON documents as node arrays, one row per document.

Spark's VARIANT drops repeated keys and bounds recursion, so a small Arrow helper lists the nodes; it
only parses. Every rule is a Catalyst expression on the node array of the same row, so facts need no
shuffle. A document is at most 10 MiB, which bounds the array.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P
from docrisk.functions import signals as S

NODE = "struct<node_id:int,parent_id:int,depth:int,key:string,key_context:string,kind:string,repeated:boolean,str_value:string>"
_NODE_ARROW = pa.list_(
    pa.struct(
        [
            ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("key", pa.string()),
            ("key_context", pa.string()), ("kind", pa.string()), ("repeated", pa.bool_()), ("str_value", pa.string()),
        ]
    )
)
_OUT_BYTES = 16 * 1024 * 1024


class _Members(list):
    """Key and value pairs of one object, repeated keys kept."""


class _Constant(ValueError):
    """NaN or an infinity."""


def _no_constant(name: str):
    raise _Constant(name)


def list_nodes(text: str) -> list[tuple]:
    """Nodes in document order; raises ValueError or RecursionError for text that is not JSON."""
    root = json.loads(text, object_pairs_hook=_Members, parse_constant=_no_constant)
    todo = [(root, -1, 0, None, "$", False)]
    nodes: list[tuple] = []
    while todo:
        value, parent, depth, key, context, repeated = todo.pop()
        here = len(nodes)
        kind = _kind(value)
        nodes.append((here, parent, depth, key, context, kind, repeated, _clean(value) if kind == "string" else None))
        if kind == "object":
            seen: set[str] = set()
            below = []
            for name, child in value:
                below.append((child, here, depth + 1, _clean(name), _clean(name), name in seen))
                seen.add(name)
            todo.extend(reversed(below))
        elif kind == "array":
            todo.extend((child, here, depth + 1, None, context, False) for child in reversed(value))
    return nodes


def _kind(value: object) -> str:
    if isinstance(value, _Members):
        return "object"
    if isinstance(value, list):
        return "array"
    if value is None:
        return "null"
    if isinstance(value, str):
        return "string"
    return "boolean" if isinstance(value, bool) else "number"


def _clean(text: str) -> str:
    """Lone surrogates cannot travel as UTF-8."""
    return text.encode("utf-8", "replace").decode("utf-8")


def _parse_one(text: str | None) -> tuple[str, str | None, list[tuple]]:
    """Status, message of a failure, nodes. The texts of the messages."""
    if text is None:
        return "invalid-text", None, []
    try:
        return "ok", None, list_nodes(text)
    except json.JSONDecodeError as err:
        return "malformed", f"Malformed JSON syntax at line {err.lineno}, column {err.colno}.", []
    except _Constant:
        return "malformed", "JSON contains a non-standard numeric constant.", []
    except (ValueError, RecursionError):
        return "malformed", "Malformed JSON syntax.", []


def parse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, file_size, parse_status, parse_error, nodes). Status: ok, malformed, invalid-text. Every document is parsed whole.

    Input and output travel in Arrow batches of bounded bytes.
    """
    src = df.select(
        F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("file_size"),
        F.regexp_replace(F.col(text_col), "^\\uFEFF", "").alias("_text"),
    )
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, file_size bigint, parse_status string, parse_error string, nodes array<{NODE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts = batch.columns[0], batch.columns[1], batch.columns[2]
            start, statuses, errors, nodes, held = 0, [], [], [], 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                status, error, found = _parse_one(text)
                statuses.append(status)
                errors.append(error)
                nodes.append(found)
                held += len(text or "") + 80 * len(found)
                if held > _OUT_BYTES or i + 1 == batch.num_rows:
                    size = i + 1 - start
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, size), sizes.slice(start, size), pa.array(statuses, pa.string()), pa.array(errors, pa.string()), _column(nodes)],
                        names=[id_col, "file_size", "parse_status", "parse_error", "nodes"],
                    )
                    start, statuses, errors, nodes, held = i + 1, [], [], [], 0

    return src.mapInArrow(run, schema)


def _column(rows: list[list[tuple]]) -> pa.Array:
    flat = [n for nodes in rows for n in nodes]
    offsets = [0]
    for nodes in rows:
        offsets.append(offsets[-1] + len(nodes))
    struct = _NODE_ARROW.value_type
    parts = [pa.array([n[k] for n in flat], struct.field(k).type) for k in range(struct.num_fields)]
    values = pa.StructArray.from_arrays(parts, fields=[struct.field(k) for k in range(struct.num_fields)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def explode(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Node table: one row per node."""
    return parsed.select(id_col, F.inline("nodes"))


def json_nodes_udtf():
    """Table function ``json_nodes(doc STRING)`` for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(
        returnType="node_id int, parent_id int, depth int, key string, key_context string, kind string, "
        "repeated boolean, str_value string"
    )
    class JsonNodes:
        def eval(self, doc: str):
            yield from _parse_one(doc)[2]

    return JsonNodes


# ---- expressions on the node array ------------------------------------------------------------
def _strings() -> Column:
    return F.filter("nodes", lambda n: n["kind"] == "string")


def _keys() -> Column:
    return F.transform(F.filter("nodes", lambda n: n["key"].isNotNull()), lambda n: n["key"])


def top_type(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("top_level_type", F.get(F.col("nodes"), F.lit(0))["kind"])


def parse_status(parsed: DataFrame) -> DataFrame:
    """Add ``ok`` and ``supported`` as far as parsing decides them, and the indicator of a failure."""
    status = F.col("parse_status")
    return (
        parsed.withColumn("ok", status.isin("ok", "malformed"))
        .withColumn("parsed", status == "ok")
        .withColumn("parse_indicator", F.when(status == "malformed", F.lit("malformed-json")))
    )


def stats(parsed: DataFrame) -> DataFrame:
    """Node, string and depth counts of the whole document, and the limits they are above.

    A limit is only reported: nothing is cut, so ``truncated`` is false.
    """
    kinds = F.transform("nodes", lambda n: n["kind"])
    chars = F.aggregate(
        "nodes", F.lit(0).cast("bigint"), lambda a, n: a + F.coalesce(F.length(n["str_value"]), F.lit(0))
    )
    base = (
        parsed.withColumn("_n", F.size("nodes"))
        .withColumn("_s", F.size(F.filter(kinds, lambda k: k == "string")))
        .withColumn("max_depth", F.coalesce(F.array_max(F.transform("nodes", lambda n: n["depth"])), F.lit(0)))
        .withColumn("string_chars", chars)
    )
    limits = F.array_compact(
        F.array(
            F.when(F.col("max_depth") > P.JSON_MAX_DEPTH, F.lit("nesting-depth-limit-exceeded")),
            F.when(F.col("_n") > P.JSON_MAX_NODES, F.lit("node-limit-exceeded")),
            F.when(F.col("_s") > P.JSON_MAX_STRINGS, F.lit("string-count-limit-exceeded")),
            F.when(F.col("file_size") > P.JSON_LIMIT, F.lit("size-limit-exceeded")),
        )
    )
    return (
        base.withColumn("limit_indicators", limits)
        .withColumn("truncated", F.lit(False))
        .withColumnsRenamed({"_n": "node_count", "_s": "string_count"})
    )


def duplicate_keys(parsed: DataFrame) -> DataFrame:
    """Occurrences beyond the first inside one object, and their distinct names."""
    again = F.transform(F.filter("nodes", lambda n: n["repeated"]), lambda n: n["key"])
    return parsed.withColumn("duplicate_key_count", F.size(again)).withColumn("duplicate_key_examples", F.array_distinct(again))


def _matching_keys(pattern: str) -> Column:
    found = F.filter(_keys(), lambda k: S.hit(k, pattern))
    return F.array_sort(F.array_distinct(found))


def sensitive_keys(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("_sens", _matching_keys(P.SENSITIVE_KEY)).withColumn(
        "sensitive_key_count", F.size("_sens")
    ).withColumn("sensitive_key_examples", F.col("_sens")).drop("_sens")


def dangerous_keys(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("_dang", _matching_keys(P.DANGEROUS_KEY)).withColumn(
        "dangerous_key_count", F.size("_dang")
    ).withColumn("dangerous_key_examples", F.col("_dang")).drop("_dang")


def string_signals(parsed: DataFrame) -> DataFrame:
    """Injection types, secret kinds, executable kinds, script-like strings, URLs and addresses.

    Only the kind of a secret is kept, never its value.
    """

    def any_of(family: dict[str, str], flags: str) -> Column:
        return F.array_compact(
            F.array(*[F.when(F.exists("_strings", lambda s: S.hit(s, family[n], flags)), F.lit(n)) for n in sorted(family)])
        )

    def distinct(of) -> Column:
        return F.array_distinct(F.flatten(F.transform("_strings", of)))

    return (
        parsed.withColumn("_strings", F.transform(_strings(), lambda n: n["str_value"]))
        .withColumn("injection_types", any_of(P.INJECT_JSON, "iUd"))
        .withColumn("secret_kinds", any_of(P.SECRETS, "Ud"))
        .withColumn("executable_kinds", any_of(P.EXEC_JSON, "iUd"))
        .withColumn("html_like_count", F.size(F.filter("_strings", S.html_like)))
        .withColumn("urls", F.transform(distinct(lambda s: S.urls(s, "json")), S.redact_url))
        .withColumn("ip_addresses", distinct(lambda s: S.ipv4(s)))
        .drop("_strings")
    )


def facts(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One facts row per document, still a narrow plan."""
    full = string_signals(dangerous_keys(sensitive_keys(duplicate_keys(stats(top_type(parse_status(parsed)))))))
    flag = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    indicators = F.array_sort(
        F.concat(
            F.col("executable_kinds"),
            F.col("limit_indicators"),
            flag(F.col("parse_indicator").isNotNull(), "malformed-json"),
            flag(F.col("dangerous_key_count") > 0, "executable-or-command-like-key"),
            flag(F.col("duplicate_key_count") > 0, "duplicate-object-keys"),
            flag(F.size("injection_types") > 0, "prompt-injection-like-instruction"),
            flag(F.size("secret_kinds") > 0, "possible-credential-or-secret-material"),
            flag(F.col("html_like_count") > 0, "html-or-script-like-content"),
            flag(F.col("string_chars") > P.JSON_LARGE_TEXT, "large-text-content"),
            flag(F.col("truncated"), "analysis-truncated"),
        )
    )
    return full.select(
        id_col,
        "file_size",
        "ok",
        F.col("parsed").alias("supported"),
        F.when(F.col("parse_status") == "malformed", F.coalesce("parse_error", F.lit("Malformed JSON syntax.")))
        .when(F.col("parse_status") == "invalid-text", F.lit("text is not UTF-8"))
        .alias("error"),
        "top_level_type",
        "node_count",
        "string_count",
        "max_depth",
        "duplicate_key_count",
        "duplicate_key_examples",
        "urls",
        "ip_addresses",
        F.size("injection_types").alias("injection_count"),
        "injection_types",
        "secret_kinds",
        "sensitive_key_count",
        "sensitive_key_examples",
        "dangerous_key_count",
        "dangerous_key_examples",
        "html_like_count",
        indicators.alias("indicators"),
        "truncated",
    )
