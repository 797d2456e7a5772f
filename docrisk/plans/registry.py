"""Formats the scan knows. Adding one needs a route, a rule list and a verdict, all DataFrame code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docrisk.operators import evidence, scoring
from docrisk.operators.evidence import Rule


@dataclass(frozen=True)
class Format:
    """``verdict`` gets (av_status, mismatch, facts struct name, evidence, score); None keeps the score verdict.

    ``missing`` is the rule that speaks when a routed file has no facts row; None lets it pass.
    """

    name: str
    route: str
    rules: Sequence[Rule]
    verdict: Callable[[Column, Column, str, Column, Column], Column] | None
    missing: Rule | None
    priority: int = 100


_FORMATS: dict[str, Format] = {}


def add(fmt: Format) -> None:
    _FORMATS[fmt.name] = fmt


def formats() -> list[Format]:
    """Registered formats in the order their verdicts take precedence."""
    return sorted(_FORMATS.values(), key=lambda f: f.priority)


def _col(f: str, name: str) -> Column:
    return F.col(f"{f}.{name}")


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


add(
    Format(
        "exe", "route_exe", evidence.EXE,
        lambda av, mm, f, ev, score: scoring.exe_verdict(av, _col(f, "supported"), mm, _empty(_col(f, "structural_warnings")), ev, score),
        evidence.EXE[0], 10,
    )
)
add(
    Format(
        "docx", "route_docx", evidence.DOCX,
        lambda av, mm, f, ev, score: scoring.docx_verdict(av, scoring.docx_review_indicators(f), mm, ev, score),
        evidence.DOCX[0], 20,
    )
)
add(
    Format(
        "json", "route_json", evidence.JSON,
        lambda av, mm, f, ev, score: scoring.json_verdict(
            av, _col(f, "ok"), _col(f, "supported"), mm, _empty(_col(f, "indicators")), score
        ),
        evidence.JSON[0], 30,
    )
)
add(Format("pdf", "route_pdf", evidence.PDF, None, None, 40))
