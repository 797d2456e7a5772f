"""Runs registered queries in Spark and their check SQL in DuckDB, and compares whole results."""

from __future__ import annotations

import collections
import datetime
import decimal
import sys
import time

from docrisk.sources.tables import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def family(name: str) -> str:
    n = name.lower()
    if any(k in n for k in ("int", "long", "short", "byte")):
        return "int"
    if any(k in n for k in ("double", "float", "decimal")):
        return "float"
    return {"boolean": "bool", "string": "str", "varchar": "str"}.get(n.split("(")[0], n)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, q, sf_dir: str) -> tuple[str, float, str]:
    from docrisk.catalog.views import Inputs

    start = time.time()
    df = q.run(Inputs(spark, sf_dir))
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if q.sql is None:
        return ("rows", took, f"{len(got)} rows") if got else ("EMPTY", took, "no rows")
    rel = con.sql(q.sql)
    if sorted(rel.columns) != cols:
        return "COLUMNS", took, f"{cols} vs {sorted(rel.columns)}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    odd = [(c, kinds[c], types[c]) for c in cols if family(kinds[c]) != family(types[c])]
    order = [rel.columns.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    a, b = collections.Counter(got), collections.Counter(want)
    if a != b:
        left, right = list((a - b).items())[:2], list((b - a).items())[:2]
        return "DIFF", took, f"{len(got)} vs {len(want)}; spark only {sum((a - b).values())} {left}; sql only {sum((b - a).values())} {right}"[:900]
    if odd:
        return "TYPES", took, str(odd)
    flat = "" if len(set(got)) > 1 or len(got) == 1 else " (constant)"
    return "ok", took, f"{len(got)} rows{flat}"


if __name__ == "__main__":
    from docrisk.catalog import load
    from docrisk.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for name, q in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, took, note = compare(spark, con, q, sf_dir)
        except Exception as err:  # noqa: BLE001
            status, took, note = "ERROR", 0.0, str(err)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:8s} {took:6.2f}s {name} {note}", flush=True)
    print("problems:", bad)
