"""Page documents: spans, objects, attachments, pages and OCR words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import patterns as P
from docrisk.functions import signals as S
from docrisk.functions.skew import per_value, top_n
from docrisk.operators import rollup as R

# Reasons and signals with the confidence each adds.
REASONS = {
    "very-small-font": 0.25,
    "near-zero-bounding-box": 0.25,
    "outside-page-boundary": 0.30,
    "very-light-text": 0.30,
    "zero-width-characters": 0.20,
    "not-visible-in-rendered-page": 0.40,
}
BONUS = {
    "prompt-injection": 0.25,
    "command-execution": 0.25,
    "credential-request": 0.25,
    "possible-obfuscation": 0.15,
    "contains-url": 0.05,
}


def rgb(color: Column) -> Column:
    """Packed colour as (red, green, blue); null stays null."""
    c = color.cast("bigint")
    part = lambda n: F.shiftright(c, n).bitwiseAND(255).cast("int")
    return F.when(c.isNotNull(), F.struct(part(16).alias("red"), part(8).alias("green"), part(0).alias("blue")))


def is_light(color: Column) -> Column:
    c = rgb(color)
    return F.coalesce(
        (c["red"] >= P.PDF_LIGHT) & (c["green"] >= P.PDF_LIGHT) & (c["blue"] >= P.PDF_LIGHT), F.lit(False)
    )


def rects_overlap(a: str, b: str) -> Column:
    """True when two boxes (columns ``a_x0`` ... ``b_y1``) share area; usable as a join condition."""
    col = lambda r, e: F.col(f"{r}_{e}")
    return ~(
        (col(a, "x1") <= col(b, "x0"))
        | (col(b, "x1") <= col(a, "x0"))
        | (col(a, "y1") <= col(b, "y0"))
        | (col(b, "y1") <= col(a, "y0"))
    )


def overlapping(spans: DataFrame, cell: float = 128.0) -> DataFrame:
    """Pairs of spans of a page (a_seq < b_seq) whose boxes share area.

    Boxes meet on the grid cells they touch; a pair counts only in the first cell both touch, so no pair
    appears twice and nothing has to be made distinct.
    """
    lo = lambda e: F.floor(F.col(e) / cell).cast("int")

    def boxed(r: str) -> DataFrame:
        cells = lambda e: F.sequence(lo(f"{e}0"), F.greatest(lo(f"{e}0"), lo(f"{e}1")))
        at = spans.withColumn("_cx", F.explode(cells("x"))).withColumn("_cy", F.explode(cells("y")))
        return at.select(
            "doc_id", "page", "_cx", "_cy", F.col("seq").alias(f"{r}_seq"), *[F.col(e).alias(f"{r}_{e}") for e in ("x0", "y0", "x1", "y1")],
            lo("x0").alias(f"{r}_cx"), lo("y0").alias(f"{r}_cy"),
        )

    pairs = boxed("a").join(boxed("b"), ["doc_id", "page", "_cx", "_cy"])
    first = (F.col("_cx") == F.greatest("a_cx", "b_cx")) & (F.col("_cy") == F.greatest("a_cy", "b_cy"))
    return pairs.where((F.col("a_seq") < F.col("b_seq")) & first & rects_overlap("a", "b")).select("doc_id", "page", "a_seq", "b_seq")


def _read_texts(spans: DataFrame) -> DataFrame:
    """Spans with what their text alone says; spans of the same text share the work."""
    text = F.col("_value")
    return per_value(spans, "text", {
        "_blank": ~S.hit(text, "\\S", "U"),
        "_size": F.size(S.tokens(text)),
        "_words": S.overlap_tokens(text),
        "_zero_width": S.has_zero_width(text),
        "_signals": S.pdf_signals(text),
        "_urls": S.urls(text, "pdf"),
        "_preview": F.regexp_replace(text, "(?U)\\s+", " "),
    })


_TEXT_COLUMNS = ("_blank", "_size", "_words", "_zero_width", "_signals", "_urls", "_preview")


def reasons(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans with hidden-text reasons and their summed confidence.

    Texts and pages are read once per distinct text, then joined; the span side is the large
    one and stays on the left, where an adaptive plan can split a skewed page.
    """
    return _flagged(spans, pages).drop(*_TEXT_COLUMNS)


def _flagged(spans: DataFrame, pages: DataFrame) -> DataFrame:
    seen = per_value(pages.select("doc_id", "page", "ocr_text"), "ocr_text", {"_visible": S.overlap_tokens(F.col("_value"))}).select(
        "doc_id", "page", "_visible", (F.coalesce("ocr_text", F.lit("")) != "").alias("_has_ocr"),
    )
    joined = _read_texts(spans).where(~F.col("_blank")).join(seen, ["doc_id", "page"], "left")
    visible = F.coalesce("_visible", F.array().cast("array<string>"))
    tests = {
        "very-small-font": (F.col("font_size") > 0) & (F.col("font_size") < P.PDF_TINY_FONT),
        "near-zero-bounding-box": (F.abs(F.col("x1") - F.col("x0")) <= 0.1) | (F.abs(F.col("y1") - F.col("y0")) <= 0.1),
        "outside-page-boundary": (F.col("x1") < -P.PDF_EDGE)
        | (F.col("x0") > F.col("page_w") + P.PDF_EDGE)
        | (F.col("y1") < -P.PDF_EDGE)
        | (F.col("y0") > F.col("page_h") + P.PDF_EDGE),
        "very-light-text": is_light(F.col("color")),
        "zero-width-characters": F.col("_zero_width"),
        "not-visible-in-rendered-page": F.coalesce("_has_ocr", F.lit(False)) & (F.col("_size") >= 2) & (F.col("visible_overlap") < P.PDF_OVERLAP),
    }
    flagged = (
        joined.withColumn("visible_overlap", S.token_overlap(F.col("_words"), visible))
        .withColumn(
            "reasons",
            S.compacted(F.array(*[F.when(F.coalesce(tests[r], F.lit(False)), F.lit(r)) for r in sorted(REASONS)])),
        )
    )
    gained = _weights("reasons", REASONS)
    return flagged.withColumn("base_confidence", gained).drop("_visible", "_has_ocr")


def _weights(names: str, table: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in table.items():
        total = total + F.when(F.array_contains(names, name), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def findings(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans with at least one reason, their content signals and final confidence."""
    return (
        _flagged(spans, pages)
        .where(F.size("reasons") > 0)
        .withColumnRenamed("_signals", "signals")
        .withColumn("hint_levels", S.risk_hints(F.col("signals")))
        .withColumnRenamed("_urls", "urls")
        .withColumn("confidence", F.least(F.round(F.col("base_confidence") + _weights("signals", BONUS), 3), F.lit(1.0)))
        .select(
            "doc_id", "page", "seq", "text", F.round("font_size", 3).alias("font_size"),
            F.array(*[F.round(c, 2) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), rgb(F.col("color")).alias("rgb"),
            "reasons", "signals", "hint_levels", "urls", F.round("visible_overlap", 3).alias("visible_overlap"), "confidence", F.col("_preview").alias("preview"),
        )
    )


def shown(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings for display: all, or the first ``limit`` of a document in page and span order."""
    return found if limit is None else top_n(found, ["doc_id"], ["page", "seq"], limit)


def hidden_measures() -> R.Measures:
    """What the findings of a document show, all of them."""
    return {
        "hidden_count": R.rows(),
        "hidden_preview": R.last_by(F.col("preview"), F.struct("confidence", -F.col("page"), -F.col("seq"))),
        "hidden_reasons": R.names(F.col("reasons")),
        "hidden_signals": R.names(F.col("signals")),
        "hidden_suspicious": R.any_(F.arrays_overlap("signals", F.array(*[F.lit(s) for s in P.PDF_HIDDEN_SIGNALS]))),
    }


def hidden_summary(found: DataFrame) -> DataFrame:
    """Per document: what its findings show, in one aggregate with small partials."""
    return R.rolled(found, "doc_id", hidden_measures())


# ---- objects ----------------------------------------------------------------------------------
def object_kinds(text: Column) -> Column:
    """Sorted suspicious kinds of one object."""
    low = F.lower(text)
    has = lambda s: F.contains(low, F.lit(s))
    return S.compacted(
        F.array(
            F.when(has("/acroform"), F.lit("acroform")),
            F.when(F.rlike(low, F.lit(r"(?U)/aa\b")), F.lit("additional-actions")),
            F.when(has("/embeddedfile"), F.lit("embedded-file")),
            F.when(F.rlike(low, F.lit(r"(?U)/(?:javascript|js)\b")), F.lit("javascript")),
            F.when(has("/launch"), F.lit("launch")),
            F.when(has("/richmedia"), F.lit("richmedia")),
            F.when(has("/xfa"), F.lit("xfa")),
        )
    )


def object_measures() -> R.Measures:
    """JavaScript count, attachment counts, other kinds as flags, on objects with kinds and attachment columns."""
    has = lambda k: F.array_contains("_kinds", k)
    attached = lambda c: F.col("is_attachment") & c
    return {
        "object_count": R.rows(),
        "javascript_count": R.count_if(has("javascript")),
        "has_additional_actions": R.any_(has("additional-actions")),
        "has_launch": R.any_(has("launch")),
        "has_rich_media": R.any_(has("richmedia")),
        "has_acroform": R.any_(has("acroform")),
        "has_xfa": R.any_(has("xfa")),
        "attachment_count": R.count_if(F.col("is_attachment")),
        "provenance_count": R.count_if(attached(F.col("is_provenance"))),
        "executable_attachments": R.count_if(attached(~F.col("is_provenance") & F.col("is_executable"))),
        "other_attachments": R.count_if(attached(~F.col("is_provenance") & ~F.col("is_executable"))),
    }


def seen_objects(objects: DataFrame) -> DataFrame:
    return attachment_columns(objects.withColumn("_kinds", object_kinds(F.col("object_text"))))


def object_flags(objects: DataFrame) -> DataFrame:
    """Per document: JavaScript count, attachment counts, other kinds as flags. One scan of the objects."""
    return R.rolled(seen_objects(objects), "doc_id", object_measures()).drop("object_count")


def suspicious(objects: DataFrame, hidden_docs: DataFrame | None = None) -> DataFrame:
    """Distinct (doc_id, xref, type), with one ``hidden-text`` marker at xref 0 per document of ``hidden_docs``."""
    rows = objects.select("doc_id", "xref", F.explode(object_kinds(F.col("object_text"))).alias("type"))
    if hidden_docs is not None:
        marks = hidden_docs.select("doc_id", F.lit(0).cast(objects.schema["xref"].dataType).alias("xref"), F.lit("hidden-text").alias("type"))
        rows = rows.unionByName(marks)
    return rows.dropDuplicates(["doc_id", "xref", "type"])


def _found(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """First match of a group, null without a match."""
    full = f"(?{flags}){pattern}"
    return F.when(F.rlike(text, F.lit(full)), F.regexp_extract(text, full, group))


def pdf_name(text: Column, key: str) -> Column:
    return _found(text, rf"/{key}\s*/([^\s<>\[\]()]+)")


def pdf_string(text: Column, key: str) -> Column:
    """Value of a key written as (text), /name or <hex>; the first form present decides."""
    name = F.replace(F.replace(F.replace(pdf_name(text, key), F.lit("#2F"), F.lit("/")), F.lit("#20"), F.lit(" ")), F.lit("#23"), F.lit("#"))
    return F.coalesce(_found(text, rf"/{key}\s*\((.*?)\)", flags="is"), name, _hex_text(_found(text, rf"/{key}\s*<([0-9A-Fa-f]+)>")))


def _hex_text(digits: Column) -> Column:
    """Decoded hex string; an odd number of digits gives null, bytes that are not UTF-8 are dropped."""
    clean = F.replace(F.make_valid_utf8(F.unhex(digits).cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(F.length(digits) % 2 == 0, clean)


def attachment_columns(objects: DataFrame) -> DataFrame:
    """Add attachment columns to objects; narrow."""
    text = F.col("object_text")
    is_attachment = F.contains(F.lower(text), F.lit("/embeddedfile"))
    pick = lambda c: F.when(is_attachment, c)
    first = F.nullif(pdf_string(text, "F"), F.lit(""))
    mime = F.trim(F.replace(F.replace(pdf_name(text, "Subtype"), F.lit("#2F"), F.lit("/")), F.lit("#20"), F.lit(" ")))
    named = (
        objects.withColumn("is_attachment", is_attachment)
        .withColumn("attachment_name", pick(F.coalesce(first, pdf_string(text, "UF"))))
        .withColumn("mime_type", pick(mime))
    )
    low = F.lower(F.concat_ws(" ", F.coalesce("attachment_name", F.lit("")), F.coalesce("mime_type", F.lit("")), text))
    marked = F.lit(False)
    for marker in P.PDF_PROVENANCE:
        marked = marked | F.contains(low, F.lit(marker))
    suffix = "(" + "|".join(e.replace(".", "\\.") for e in P.PDF_EXECUTABLE) + ")$"
    runs = F.coalesce(F.rlike(F.lower(F.trim("attachment_name")), F.lit(suffix)), F.lit(False)) | F.coalesce(
        F.lower(F.trim("mime_type")).isin(*P.PDF_EXECUTABLE_MIME), F.lit(False)
    )
    return (
        named.withColumn("relationship", pick(pdf_name(text, "AFRelationship")))
        .withColumn("attachment_size", pick(_found(text, r"/Length\s+(\d+)")).cast("bigint"))
        .withColumn("is_provenance", F.coalesce(pick(marked), F.lit(False)))
        .withColumn("is_executable", runs)
    )


def attachments(objects: DataFrame) -> DataFrame:
    """One row per embedded file."""
    return attachment_columns(objects).where("is_attachment").select(
        "doc_id", "xref", "attachment_name", "mime_type", "relationship", "attachment_size", "is_provenance", "is_executable"
    )


def _action(body: Column) -> Column:
    """Struct (raw_type, type, target) of an action dictionary."""
    raw = _found(body, r"/S\s*/([A-Za-z0-9]+)")
    kind = F.when(raw.isin(*P.PDF_ACTIONS), raw).otherwise(F.lit("Unknown"))
    file = _found(body, r"/F\s*\((.*?)\)", flags="is")
    script = F.coalesce(
        F.when(_found(body, r"/JS\s*\((.*?)\)", flags="is") != "", _found(body, r"/JS\s*\((.*?)\)", flags="is")),
        _hex_text(_found(body, r"/JS\s*<([0-9A-Fa-f]+)>")),
    )
    target = (
        F.when(kind == "URI", F.coalesce(_found(body, r"/URI\s*\((.*?)\)", flags="is"), _hex_text(_found(body, r"/URI\s*<([0-9A-Fa-f]+)>"))))
        .when(kind == "Launch", file)
        .when(kind == "JavaScript", script)
        .when(kind == "GoTo", F.lit("internal document destination"))
        .when(kind == "GoToR", F.coalesce(file, F.lit("remote document destination")))
    )
    return F.struct(raw.alias("raw_type"), kind.alias("type"), target.alias("target"))


def open_action(objects: DataFrame) -> DataFrame:
    """Per document with an open action: type, raw type and target.

    The catalog is the lowest xref that says so. An action given by reference is looked up by
    (doc_id, xref), and only the objects found are read for its fields.
    """
    text = F.col("object_text")
    catalogs = (
        objects.where(F.rlike(text, F.lit(r"/Type\s*/Catalog\b")))
        .groupBy("doc_id")
        .agg(F.min_by("object_text", "xref").alias("_catalog"))
        .select(
            "doc_id",
            _found(F.col("_catalog"), r"/OpenAction\s+(\d+)\s+\d+\s+R").cast(objects.schema["xref"].dataType).alias("_ref"),
            _found(F.col("_catalog"), r"/OpenAction\s*<<([\s\S]*?)>>").alias("_inline"),
        )
        .where(F.col("_ref").isNotNull() | F.col("_inline").isNotNull())
    )
    inline = catalogs.where(F.col("_ref").isNull()).select("doc_id", _action(F.col("_inline")).alias("a"))
    targets = objects.where(F.coalesce(text, F.lit("")) != "").select("doc_id", F.col("xref").alias("_ref"), "object_text")
    unknown = F.struct(F.lit(None).cast("string").alias("raw_type"), F.lit("Unknown").alias("type"), F.lit(None).cast("string").alias("target"))
    by_ref = (
        catalogs.where(F.col("_ref").isNotNull())
        .join(targets, ["doc_id", "_ref"], "left")
        .select("doc_id", F.when(F.col("object_text").isNull(), unknown).otherwise(_action(F.col("object_text"))).alias("a"))
    )
    return inline.unionByName(by_ref).select(
        "doc_id", F.col("a.type").alias("action_type"), F.col("a.raw_type").alias("action_raw_type"), F.col("a.target").alias("action_target")
    )


# ---- pages ------------------------------------------------------------------------------------
def page_measures(columns: list[str]) -> R.Measures:
    """Pages, native text length, annotations, form fields, and how OCR went on pages without native text."""
    optional = lambda c: F.col(c) if c in columns else F.lit(0)
    without = F.coalesce("native_len", F.lit(0)) == 0
    read = F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) if "ocr_text" in columns else F.lit(0)
    return {
        "page_count": R.rows(),
        "text_length": R.total(F.col("native_len")),
        "annotation_count": R.total(optional("annotations")),
        "form_field_count": R.total(optional("form_fields")),
        "pages_without_text": R.count_if(without),
        "_read": R.count_if(without & (read > 0)),
        "_failed": R.count_if(without & (read == 0)),
        "_chars": R.total(F.when(without, read)),
    }


def page_finish(rolled: DataFrame, ocr_available: bool = True) -> DataFrame:
    """OCR counts and the source of the text, from the measures of pages."""
    zero = F.lit(0).cast("bigint")
    if ocr_available:
        # Page texts are joined with one line feed.
        ocr = {
            "ocr_page_count": F.coalesce("_read", zero), "ocr_errors": F.coalesce("_failed", zero),
            "ocr_length": F.coalesce(F.col("_chars") + F.greatest(F.col("_read") - 1, zero), zero),
            "ocr_page_limit_reached": F.col("pages_without_text") > P.PDF_OCR_PAGES,
        }
    else:
        ocr = {
            "ocr_page_count": zero, "ocr_errors": F.when(F.col("pages_without_text") > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
            "ocr_length": zero, "ocr_page_limit_reached": F.lit(False),
        }
    source = (
        F.when((F.col("text_length") > 0) & (F.col("ocr_length") > 0), F.lit("mixed"))
        .when(F.col("text_length") > 0, F.lit("native"))
        .when(F.col("ocr_length") > 0, F.lit("ocr"))
        .otherwise(F.lit("none"))
    )
    out = rolled.withColumns({**ocr, "ocr_available": F.lit(ocr_available), "ocr_attempted": F.col("pages_without_text") > 0})
    return out.withColumn("text_source", source).drop("_read", "_failed", "_chars")


def page_facts(pages: DataFrame) -> DataFrame:
    """Per document: pages, native text length, annotations, form fields and distinct URL count."""
    rolled = R.rolled(pages, "doc_id", page_measures(pages.columns))
    return _with_urls(rolled, pages).select("doc_id", "page_count", "text_length", "annotation_count", "form_field_count", "url_count")


def _with_urls(rolled: DataFrame, pages: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    if "urls" not in pages.columns:
        return rolled.withColumn("url_count", zero)
    counted = page_urls(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("url_count"))
    return rolled.join(counted, "doc_id", "left").withColumn("url_count", F.coalesce("url_count", zero))


def page_urls(pages: DataFrame) -> DataFrame:
    """Distinct link targets per document as rows; their number has no limit, so they are no array."""
    return pages.select("doc_id", F.explode("urls").alias("url")).where(F.col("url") != "").distinct()


def text_source(pages: DataFrame, ocr_available: bool = True) -> DataFrame:
    """Per document: where its text comes from and how OCR went, over all pages without native text."""
    out = page_finish(R.rolled(pages, "doc_id", page_measures(pages.columns)), ocr_available)
    return out.drop("page_count", "annotation_count", "form_field_count").withColumnRenamed("text_length", "native_length")


def ocr_text(words: DataFrame) -> DataFrame:
    """Page text from OCR words (doc_id, page, seq, word): blanks dropped, joined in order.

    The result is one text per page, so the words of a page meet in one row.
    """
    return (
        words.where(F.trim(F.coalesce("word", F.lit(""))) != "")
        .groupBy("doc_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.trim("word").alias("word")))).alias("_w"))
        .select("doc_id", "page", F.size("_w").alias("word_count"), F.array_join("_w.word", " ").alias("ocr_text"))
    )


def metadata(df: DataFrame, col: str = "metadata") -> DataFrame:
    """Metadata map without empty values."""
    return df.withColumn(col, F.map_filter(col, lambda _, v: F.coalesce(v, F.lit("")) != ""))


def facts(objects: DataFrame, spans: DataFrame, pages: DataFrame, ocr_available: bool = True) -> DataFrame:
    """One facts row per document that has pages or objects, with defaults."""
    rolled = page_finish(R.rolled(pages, "doc_id", page_measures(pages.columns)), ocr_available)
    docs = (
        _with_urls(rolled, pages)
        .join(object_flags(objects), "doc_id", "full")
        .join(open_action(objects), "doc_id", "left")
        .join(hidden_summary(findings(spans, pages)), "doc_id", "left")
    )
    return docs.select("doc_id", *facts_columns(ocr_available))


def facts_columns(ocr_available: bool = True) -> list[Column]:
    """Facts of a document from its finished measures."""
    none = F.array().cast("array<string>")
    defaults: dict[str, Column] = {
        "page_count": F.lit(0), "text_length": F.lit(0), "annotation_count": F.lit(0), "form_field_count": F.lit(0),
        "url_count": F.lit(0), "pages_without_text": F.lit(0), "ocr_page_count": F.lit(0), "ocr_errors": F.lit(0),
        "ocr_length": F.lit(0), "ocr_available": F.lit(ocr_available), "ocr_attempted": F.lit(False), "text_source": F.lit("none"),
        "javascript_count": F.lit(0), "has_additional_actions": F.lit(False), "has_launch": F.lit(False),
        "has_rich_media": F.lit(False), "has_acroform": F.lit(False), "has_xfa": F.lit(False), "attachment_count": F.lit(0),
        "provenance_count": F.lit(0), "executable_attachments": F.lit(0), "other_attachments": F.lit(0),
        "hidden_count": F.lit(0), "hidden_reasons": none, "hidden_signals": none, "hidden_suspicious": F.lit(False),
        "hidden_preview": F.lit(""),
    }
    return [
        F.lit(True).alias("supported"),
        F.col("action_type").isNotNull().alias("has_open_action"),
        F.col("action_type"),
        F.col("action_raw_type"),
        F.col("action_target"),
        *[F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()],
    ]


def sources(objects: DataFrame, spans: DataFrame, pages: DataFrame, prefix: str) -> list[R.Source]:
    """The tables of page documents as sources of one fold, see ``finish``.

    An open action that points at another object needs a look-up by (document, object), so it is a source of its own.
    """
    out = [
        R.Source(seen_objects(objects), "doc_id", prefix, object_measures()),
        R.Source(open_action(objects), "doc_id", prefix, {c: R.only(F.col(c)) for c in ("action_type", "action_raw_type", "action_target")}),
        R.Source(findings(spans, pages), "doc_id", prefix, hidden_measures()),
        R.Source(pages, "doc_id", prefix, page_measures(pages.columns)),
    ]
    if "urls" in pages.columns:
        out.append(R.Source(page_urls(pages), "doc_id", prefix, {"url_count": R.rows()}))
    return out


def finish(rolled: DataFrame, ocr_available: bool = True) -> tuple[DataFrame, Column]:
    """What ``facts_columns`` needs, and whether a row is a page document at all."""
    out = page_finish(rolled, ocr_available)
    if "url_count" not in out.columns:
        out = out.withColumn("url_count", F.lit(0).cast("bigint"))
    return out, (F.col("page_count") > 0) | (F.col("object_count") > 0)
