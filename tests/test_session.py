"""Session defaults, and what they do to a large shuffle."""

import pytest

import __spark_entry__ as contract
from docrisk.operators import office
from docrisk.session import FEW, NARROW, PARTITIONS, tune

SIZE, START = next(iter(NARROW)), next(iter(FEW))


@pytest.fixture
def session(spark):
    """A session of its own, with two partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def test_part_counts_spread_beyond_the_partitions_of_the_session(session, small):
    session.conf.set(SIZE, "16k")
    session.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    found = contract.queries()["office_part_counts"](session, small)
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2


def test_part_counts_stay_whole(session):
    tune(session, narrow=True)
    rows = [(i % 3000, f"{'word/' * (i % 2)}{'P' if i % 5 else 'p'}{i % 4}.xml") for i in range(30000)] + [(1, "a.bin"), (1, None)]
    got = office.part_counts(session.createDataFrame(rows, "doc_id long, name string"))
    assert got.agg({"parts": "sum"}).first()[0] == 30000
    assert got.count() == got.select("doc_id", "base").distinct().count()


def test_values_of_the_cluster_win(session):
    session.conf.set(SIZE, "8m")
    tune(session, narrow=True)
    assert session.conf.get(SIZE) == "8m" and session.conf.get(START) == str(PARTITIONS)
    session.conf.set("spark.sql.shuffle.partitions", "3000")
    tune(session, narrow=True)
    assert session.conf.get(START, None) is None


def test_operators_on_texts_keep_the_settings_of_the_session(session):
    before = session.conf.get(SIZE)
    tune(session, narrow=True)
    assert session.conf.get(SIZE) == NARROW[SIZE]
    tune(session)
    assert session.conf.get(SIZE) == before and session.conf.get(START, None) is None
