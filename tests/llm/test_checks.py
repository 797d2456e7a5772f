"""Registered corpus queries against their check SQL, whole results."""

import collections

import pytest

from docrisk.llm import queries
from tests.compare import duck, family, plain


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rel = duck(small).sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    assert all(family(kinds[c]) == family(str(t)) for c, t in zip(rel.columns, rel.types))
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    order = [rel.columns.index(c) for c in cols]
    want = collections.Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
