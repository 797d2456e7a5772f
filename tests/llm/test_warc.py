import base64
import gzip
import hashlib
import io

import pytest

from docrisk.llm import warc
from docrisk.session import work_folder


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, file string")


def test_round_trip(spark):
    long_page = "ä<p>" + "x€" * 300_000
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "same"), (4, "d", None), (5, "e", ""), (6, "f", long_page),
            (7, "g", "WARC/1.1\r\n\r\n\x1f\u008b\x08 Content-Length: 3\r\n\r\n"), (None, "h", "same"), (None, "i", "alone")]
    got = sorted(map(tuple, warc.round_trip(spark, pages_of(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        top = best.get(h or "")
        revisit = top is not None and top != i
        want.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "xy"), (2, "a", "xy"), (3, "a", "long one"), (4, "a", "long one")]
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(spark, pages_of(spark, rows), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


@pytest.mark.parametrize("split", [64, 700, 5000])
def test_any_split_reads_every_record_once(spark, split):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i % 40)) for i in range(200)]
    folder = work_folder(spark, "warc-test")
    manifest = warc.write(pages_of(spark, rows).repartition(2), folder)
    got = warc.read(manifest, folder, split).select(warc.page_of("record_id").alias("p"), "payload").collect()
    assert sorted(r["p"] for r in got) == list(range(200))
    assert all(r["payload"] is None or bytes(r["payload"]).decode() == rows[r["p"]][2] for r in got)


def test_members_are_plain_gzip_and_junk_between_is_skipped():
    one = warc.record_bytes(1, "u", b"hello", warc.digest(b"hello"), None)
    two = warc.record_bytes(2, "u", b"bye", warc.digest(b"bye"), None)
    assert gzip.decompress(one).startswith(b"WARC/1.1")
    data = b"\x1f\x8b\x08junk" + one + b"\x1f\x8b\x08\x00zz" + two
    found = [warc.parse(d)["payload"] for _, d in warc.read_range(io.BytesIO(data), 0, len(data))]
    assert found == [b"hello", b"bye"]
    assert [o for o, _ in warc.read_range(io.BytesIO(data), 8, len(data))] == [len(data) - len(two)]


def test_empty_table(spark):
    assert warc.round_trip(spark, pages_of(spark, [(1, "a", "b")]).limit(0)).count() == 0
