"""Rows that land as files."""

import os

import pytest

from docrisk.catalog.identity_queries import read_files
from docrisk.catalog.views import Inputs
from docrisk.session import work_folder
from docrisk.sources import files, sinks


def test_files_share_folders_and_a_second_write_adds_nothing(spark):
    rows = spark.range(2500).selectExpr("concat(id, '.bin') as filename", "cast(concat('x', id) as binary) as content")
    path = work_folder(spark, "landing") + "/in"
    assert sinks.write_files(rows, path) == 2500
    assert sinks.write_files(rows, path) == 2500
    assert len(os.listdir(path.removeprefix("file://"))) == 2  # not one folder per file
    got = {(r.filename, bytes(r.content)) for r in files.read_files(spark, path).collect()}
    assert files.read_files(spark, path).count() == 2500 and got == {(f"{i}.bin", f"x{i}".encode()) for i in range(2500)}


def test_no_rows_no_files(spark):
    path = work_folder(spark, "landing") + "/in"
    assert sinks.write_files(spark.createDataFrame([], "filename string, content binary"), path) == 0
    assert files.read_files(spark, path).count() == 0


def test_documents_that_share_an_id_are_files_of_their_own(spark, tmp_path):
    rows = [(7, "b"), (7, "a\nc"), (-3, ""), (None, "x"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in read_files(Inputs(spark, str(tmp_path))).collect())
    assert got == [(False, -3, 1), (False, 7, 2), (False, 7, 4), (True, 0, 2)]


def test_the_driver_lists_no_files(spark):
    def landed(n):
        path = work_folder(spark, "landing") + "/in"
        sinks.write_files(spark.range(n).selectExpr("concat(id, '.bin') as filename", "cast(concat('x', id) as binary) as content"), path)
        return files.read_files(spark, path)

    few, many = landed(3), landed(2500)
    assert few.inputFiles() == many.inputFiles() == []  # Spark's reader names them all
    assert few.rdd.getNumPartitions() == many.rdd.getNumPartitions()
    assert sorted(bytes(r.content) for r in many.collect()) == sorted(f"x{i}".encode() for i in range(2500))


def test_contents_are_not_read_where_unused(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"1234")
    plan = files.read_files(spark, str(tmp_path)).where("size > 3").select("filename", "size")
    assert "content" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in plan.collect()] == [("one", 4)]


def test_files_are_those_of_sparks_reader(spark, tmp_path):
    names = ["a.txt", "sp ace.bin", "p%20q", "c#d", "c", "é.txt", "_x=1", "k=1/deep/f", "k=1/deep/.f", "k=1/empty"]
    names += ["_x", ".h", "b._COPYING_", "_metadata", "_common_metadata9", "_sub/f", ".sub/f"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * (0 if name.endswith("empty") else 3))
    (tmp_path / "link").symlink_to(tmp_path / "k=1")
    (tmp_path / "none").mkdir()
    base, odd = str(tmp_path), ("/a.txt", "/none", "/k=*/de*", "/c#d", "/c?d", "/p%20q", "/sp ace.bin", "/é.txt", "/[ab].txt", "/{a,b}.txt")
    for path in (base, base + "/", *(start + end for start in (base, "file://" + base) for end in ("", *odd))):
        want = files.spark_files(spark, path)
        got = files.read_files(spark, path)
        assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
        millis = "unix_millis(arrived_at) as arrived_at"
        columns = ["path", "filename", "size", millis, "content"]
        read = sorted(map(tuple, got.selectExpr(*columns).collect()))
        assert [r for r in read if r[2]] == sorted(map(tuple, want.selectExpr(*columns).collect())), path
        assert [r[1] for r in read if not r[2]] == ["empty", "empty"] * (path.rstrip("/").endswith(tmp_path.name))  # Spark's reader drops them
        assert sorted(r.path for r in files.list_files(spark, path).collect()) == [r[0] for r in read]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_files(spark, f"{tmp_path}/missing")


def test_large_contents_leave_python_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BATCH_BYTES", 10)
    sizes = [0, 3, 30, 10, 9, 1, 0, 100]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i}").write_bytes(bytes([i]) * n)
    got = {int(r.filename): bytes(r.content) for r in files.read_files(spark, str(tmp_path)).coalesce(1).collect()}
    assert got == {i: bytes([i]) * n for i, n in enumerate(sizes)}


def test_texts_are_not_shuffled_to_be_named(spark, tmp_path, monkeypatch):
    rows = [(i % 5, f"t{i % 7}") for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    seen, write = [], sinks.write_files
    monkeypatch.setattr(sinks, "write_files", lambda df, path: seen.append(df) or write(df, path))
    got = read_files(Inputs(spark, str(tmp_path)))
    assert sorted((r.doc_id, r["size"]) for r in got.collect()) == sorted((i, 3) for i, _ in rows)  # equal rows too
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
