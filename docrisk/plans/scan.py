"""The whole scan: files, verdicts and facts to one result row per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrisk.functions import signals as S
from docrisk.operators import binary, evidence, identity, office, pdfspans, scoring, verdicts
from docrisk.operators import rollup as R
from docrisk.plans import registry


def _missing(fmt: registry.Format) -> Column:
    """Evidence of a routed file without facts."""
    if fmt.missing is None:
        return F.array().cast(evidence.EVIDENCE)
    r = fmt.missing
    return F.array(
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.title).alias("title"),
            F.lit("no facts for this file").alias("description"), F.lit(r.severity).alias("severity"),
            F.lit(r.source).alias("source"), F.lit(r.score).alias("score"), F.lit(1).cast("bigint").alias("occurrences"),
        )
    ).cast(evidence.EVIDENCE)


def scan(files: DataFrame, av: DataFrame, facts: dict[str, DataFrame], pdf_fail_open: bool = True) -> DataFrame:
    """One result row per file, from facts that are rows already.

    ``files``: file_id, user_id, sha256, size, filename, head_hex. ``facts``: format name to facts rows
    keyed by their first column. Evidence is compiled on the facts rows and travels as an array whose
    length is the number of rules, so score and verdict are expressions on the joined row: after the
    joins on file id there is no further shuffle.
    """
    out = verdicts.attach(files, av)
    known = [f for f in registry.formats() if f.name in facts]
    for fmt in known:
        rows = evidence.with_evidence(facts[fmt.name], fmt.rules, "_ev")
        key = facts[fmt.name].columns[0]
        side = rows.select(
            F.col(key).alias("file_id"), F.struct(*[c for c in facts[fmt.name].columns if c != key]).alias(f"{fmt.name}_facts"),
            F.col("_ev").alias(f"_{fmt.name}_evidence"),
        )
        out = out.join(side, "file_id", "left")
    return decided(out, known, pdf_fail_open)


@dataclass(frozen=True)
class Tables:
    """Fact tables of a scan; a format whose tables are None is not looked at.

    ``pdf``: objects, spans, pages. ``exe``: headers, sections, imports, string facts or None. ``docx``: entries, runs, rels,
    XML parts or None. ``json``: facts rows. The key is the file's id.
    """

    pdf: tuple[DataFrame, DataFrame, DataFrame] | None = None
    exe: tuple[DataFrame, DataFrame, DataFrame, DataFrame | None] | None = None
    docx: tuple[DataFrame, DataFrame, DataFrame, DataFrame | None] | None = None
    json: DataFrame | None = None

    def sources(self) -> list[R.Source]:
        out = []
        if self.pdf:
            out += pdfspans.sources(*self.pdf, "pdf_")
        if self.exe:
            out += binary.sources(*self.exe, "exe_")
        if self.docx:
            out += office.sources(*self.docx, "docx_")
        if self.json is not None:
            key = self.json.columns[0]
            out.append(R.Source(self.json, key, "json_", {"facts": R.only(F.struct(*[c for c in self.json.columns if c != key]))}))
        return out

    def finished(self, name: str, rows: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
        """A format's measures under their plain names to what its facts need, whether it has facts, and these."""
        if name == "pdf":
            return *pdfspans.finish(rows), pdfspans.facts_columns()
        if name == "docx":
            return *office.finish(rows), office.facts_columns()
        if name == "exe":
            headers = self.exe[0].columns
            return binary.checked(rows, headers), F.col("header_count") > 0, binary.facts_columns(headers)
        return rows, F.col("facts").isNotNull(), [F.col(f"facts.{c}").alias(c) for c in rows.schema["facts"].dataType.names]


def scan_tables(files: DataFrame, av: DataFrame, tables: Tables, pdf_fail_open: bool = True) -> DataFrame:
    """One result row per file, straight from the fact tables.

    Files and all fact tables are one tagged union with one exchange on the file id, of partial aggregates (see
    ``operators.rollup``). What follows, from facts to verdict, is narrow. A file that many fact rows belong to is
    combined before the exchange; rows of files that are not scanned fall away after it.
    """
    seen = verdicts.attach(files, av)
    given = [c for c in seen.columns if c != "file_id"]
    file_rows = R.Source(seen, "file_id", "file_", {"row": R.only(F.struct(*given))})
    out = R.folded([file_rows, *tables.sources()], "file_id").where(F.col("file_row").isNotNull())
    known = [f for f in registry.formats() if getattr(tables, f.name, None) is not None]
    for fmt in known:
        prefix = f"{fmt.name}_"
        keep = [c for c in out.columns if not c.startswith(prefix)]
        rows, has_facts, cols = tables.finished(fmt.name, R.unprefixed(out, prefix))
        rows = rows.select(*keep, has_facts.alias("_has_facts"), *cols)
        names = [c for c in rows.columns if c not in (*keep, "_has_facts")]
        out = rows.select(
            *keep, F.when(F.col("_has_facts"), F.struct(*names)).alias(f"{fmt.name}_facts"),
            F.when(F.col("_has_facts"), evidence.compiled(fmt.rules)).alias(f"_{fmt.name}_evidence"),
        )
    rest = [c for c in out.columns if c not in ("file_id", "file_row")]
    return decided(out.select("file_id", *[F.col(f"file_row.{c}").alias(c) for c in given], *rest), known, pdf_fail_open)


def decided(out: DataFrame, known: list[registry.Format], pdf_fail_open: bool = True) -> DataFrame:
    """Type, routes, evidence, score, level and verdict of files with their facts; narrow."""
    out = identity.detect_type(out)
    if "docx_facts" in out.columns:
        # A ZIP container whose parts make a valid package is a word-processor document.
        office_file = (F.col("detected_type") == "zip") & F.coalesce(F.col("docx_facts.supported"), F.lit(False))
        out = out.withColumn("detected_type", F.when(office_file, F.lit("docx")).otherwise(F.col("detected_type")))
    out = scoring.uninspected(identity.route(identity.mismatch(out)).withColumn("extension", identity.extension(F.col("filename"))))
    parts = [evidence.compiled(evidence.GENERIC)]
    for fmt in known:
        default = _missing(fmt)
        if fmt.name == "pdf" and not pdf_fail_open:
            default = _missing(registry.Format("pdf", "route_pdf", (), None, evidence.Rule(
                "EP-0", "true", "pdf-analysis", "high", 20, "pdf-structure-analysis", "Analysis incomplete")))
        none = F.array().cast(evidence.EVIDENCE)
        parts.append(F.when(F.col(fmt.route), F.coalesce(F.col(f"_{fmt.name}_evidence"), default)).otherwise(none))
    out = out.withColumn("evidence", F.concat(*parts)).withColumn("risk_score", scoring.array_score(F.col("evidence")))
    out = out.withColumn("risk_level", scoring.level(F.col("risk_score")))
    generic = scoring.pdf_guard(scoring.base_verdict(F.col("risk_score")), F.col("evidence"))
    routes = [
        (
            F.col(fmt.route),
            fmt.verdict(F.col("av_status"), F.col("extension_mismatch"), f"{fmt.name}_facts", F.col("evidence"), F.col("risk_score")),
        )
        for fmt in known
        if fmt.verdict is not None
    ]
    out = out.withColumn("verdict", scoring.final_verdict(routes, generic) if routes else generic)
    return out.drop(*[f"_{f.name}_evidence" for f in known])


def routed(files: DataFrame, route: str) -> DataFrame:
    """Ids of the files that take a route by name or by leading bytes."""
    known = identity.route(identity.detect_type(files))
    # A ZIP container may turn out to be a word-processor document, so it goes that way too.
    applies = F.col(route) | (F.col("detected_type") == "zip") if route == "route_docx" else F.col(route)
    return known.where(applies).select("file_id")


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the routed files: a semi join on narrow ids before the costly work on the rows."""
    return rows.join(ids.withColumnRenamed("file_id", key), key, "left_semi")


TEXT_RULES = tuple(r for r in evidence.JSON if r.rule_id in ("EJ-3", "EJ-5")) + evidence.GENERIC[1:]


def text_facts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Hash and signals of plain text rows; the text itself is dropped. Narrow."""
    t = F.col(text)
    return (
        texts.withColumn("sha256", F.sha2(t, 256))
        .withColumn("injection_types", S.injection_types(t))
        .withColumn("secret_kinds", S.secret_kinds(t))
        .withColumn("injection_count", F.size("injection_types"))
        .withColumn("url_count", F.size(S.urls(t, "json")))
        .withColumn("ip_count", F.size(S.ipv4(t)))
        .withColumn("supported", F.lit(True))
        .drop(text)
    )


def text_scan(texts: DataFrame, av: DataFrame) -> DataFrame:
    """Score plain texts: signals, verdict by hash, evidence, score, level. One join, no other shuffle.

    Works on a batch table and on a stream, where ``av`` stays a static table.
    """
    scored = evidence.with_evidence(verdicts.attach(text_facts(texts), av), TEXT_RULES)
    return scored.withColumn("risk_score", scoring.array_score(F.col("evidence"))).withColumn(
        "risk_level", scoring.level(F.col("risk_score"))
    )
