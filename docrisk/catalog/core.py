"""Registration of queries: a DataFrame function over `Inputs` and, where SQL can say it, the check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docrisk.catalog.views import Inputs, check_sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register the decorated function under ``name``; ``covers`` lists the inventory rows."""

    def keep(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} exists")
        CATALOG[name] = Query(name, covers, fn, check_sql(sql) if sql else None)
        return fn

    return keep


# ---- small writers for check SQL ---------------------------------------------------------------
def text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def hit(col: str, pattern: str, flags: str = "i") -> str:
    """Regex test; flags of the check engine, null counts as false."""
    lead = f"(?{flags})" if flags else ""
    return f"coalesce(regexp_matches({col}, {text(lead + pattern)}), false)"


def any_hit(col: str, family: tuple[str, ...], flags: str = "i") -> str:
    return "(" + " or ".join(hit(col, p, flags) for p in family) + ")"


def names(pairs: list[tuple[str, str]], sep: str = ",") -> str:
    """Joined names whose condition holds; pairs are (condition, name) in output order."""
    items = ", ".join(f"case when {c} then {text(n)} end" for c, n in pairs)
    return f"coalesce(array_to_string(list_filter([{items}], lambda x: x is not null), '{sep}'), '')"


def squeeze(col: str) -> str:
    return rf"trim(regexp_replace({col}, '\s+', ' ', 'g'))"


def in_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"
