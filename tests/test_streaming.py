"""Streams end with what the batch functions give; an open scan fails after its time."""

from pyspark.sql import functions as F

from docrisk.operators import lifecycle
from docrisk.streaming import arrivals, scans, state


def _feed(spark, tmp_path, rows, files):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "scan_id bigint, seq bigint, ts string, state string").withColumn("ts", F.to_timestamp("ts"))
    for part in range(files):
        df.where(F.col("seq") % files == part).coalesce(1).write.mode("append").parquet(path)
    return df, arrivals.read_folder(spark, path, df.schema, bytes_per_trigger=1)  # a file per batch


def test_late_end_with_lower_number_wins(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "analyzing"), (1, 3, "2024-01-01 00:00:02", "failed"), (1, 2, "2024-01-01 00:00:01", "completed"), (2, 4, "2024-01-01 00:00:03", "analyzing")]
    batch, stream = _feed(spark, tmp_path, rows, 4)
    arrivals.run_to_end(state.transitions(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {(r.scan_id, r.state, r.final_seq) for r in state.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {(r.scan_id, r.state, r.final_seq) for r in lifecycle.current_state(batch).collect()}
    assert got == want == {(1, "completed", 2), (2, "analyzing", None)}


def test_open_scan_times_out(spark, tmp_path):
    rows = [(1, 0, "2024-01-01 00:00:00", "analyzing"), (2, 1, "2024-01-01 02:00:00", "completed"), (3, 2, "2024-01-01 04:00:00", "completed")]
    _, stream = _feed(spark, tmp_path, rows, 3)
    arrivals.run_to_end(state.transitions(stream, "1 second", timeout_ms=30_000), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r.scan_id: r.state for r in state.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {1: "failed", 2: "completed", 3: "completed"}


def test_store_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "r"), (2, 1, "r"), (3, 2, "q")], "seq int, user_id int, request_id string")
    handle = arrivals.store_new_requests(str(tmp_path / "store"))
    handle(df, 0)
    handle(df, 0)
    assert sorted((r.seq, r.request_id) for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [(1, "r"), (3, "q")]
    more = spark.createDataFrame([(4, 1, "r"), (5, 9, "r")], "seq int, user_id int, request_id string")
    handle(more, 1)
    handle(more, 1)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 3, 5]


def test_rows_without_request_id_all_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, "r")], "seq int, user_id int, request_id string")
    handle = arrivals.store_new_requests(str(tmp_path / "store"))
    for _ in range(2):
        handle(df, 0)
        handle(df.where("seq > 1"), 1)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2, 2, 3]


def test_late_end_does_not_open_a_scan_that_timed_out(spark, tmp_path):
    rows = [
        (1, 0, "2024-01-01 00:00:00", "analyzing"), (2, 1, "2024-01-01 02:00:00", "completed"), (3, 2, "2024-01-01 04:00:00", "completed"),
        (1, 3, "2024-01-01 04:00:30", "completed"), (4, 4, "2024-01-01 06:00:00", "completed"),
    ]
    _, stream = _feed(spark, tmp_path, rows, 5)
    arrivals.run_to_end(state.transitions(stream, "1 second", timeout_ms=30_000), str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {r.scan_id: r.state for r in state.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {1: "failed", 2: "completed", 3: "completed", 4: "completed"}


def _meeting(spark, tmp_path, arrived, announced, timeout_ms=60_000):
    """Batches of (file_id, second, wanted) and (file_id, second, format), a file each, and the decisions on them."""
    base, feeds = 1_704_067_200, []
    for name, col, batches in (("arrived", "wanted", arrived), ("announced", "format", announced)):
        schema = f"file_id long, ts timestamp, {col} string"
        for n, rows in enumerate(batches):
            data = spark.createDataFrame(rows, f"file_id long, s long, {col} string")
            data = data.select("file_id", F.timestamp_seconds(F.col("s") + base).alias("ts"), col)
            data.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"n={n}"))
        feeds.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name / "n=*")))
    stream = scans.ready(*feeds, delay="1 second", timeout_ms=timeout_ms)
    arrivals.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    rows = spark.read.schema(scans.OUTPUT).parquet(str(tmp_path / "out")).collect()
    return sorted((r.file_id, r.known, r.timed_out) for r in rows)


def test_files_and_facts_meet(spark, tmp_path):
    arrived = [[(1, 0, "pdf"), (2, 0, "docx,pdf"), (3, 0, ""), (4, 0, "exe"), (1, 5, "pdf")], [(5, 10, "json"), (None, 9_000, None)]]
    announced = [[(1, 3, "pdf"), (2, 4, "docx"), (5, 2, "json"), (5, 2, "json"), (9, 1, "pdf")], [(2, 20, "pdf"), (None, 9_000, None)]]
    got = _meeting(spark, tmp_path, arrived, announced)
    assert got == [(1, "pdf", False), (2, "docx,pdf", False), (3, "", False), (4, "", True), (5, "json", False)]


def test_facts_after_the_time_out_change_nothing(spark, tmp_path):
    arrived = [[(1, 0, "docx,pdf"), (7, 0, "pdf")], [(None, 500, None)], [(None, 600, None)], [(None, 700, None)]]
    announced = [[(1, 1, "pdf"), (7, 1, "pdf")], [(None, 500, None)], [(None, 600, None)], [(1, 650, "docx"), (7, 650, "pdf"), (None, 700, None)]]
    assert _meeting(spark, tmp_path, arrived, announced) == [(1, "pdf", True), (7, "pdf", False)]


def test_files_of_one_bucket_keep_their_own_time(spark, tmp_path, monkeypatch):
    ready, big = scans.ready, 2**53 + 1  # an id that a floating point number cannot hold
    monkeypatch.setattr(scans, "ready", lambda *a, **k: ready(*a, buckets=1, **k))
    arrived = [[(1, 0, "pdf"), (2, 0, "pdf"), (big, 0, "")], [(3, 500, "pdf"), (4, 500, "exe")], [(None, 600, None)], [(None, 700, None)]]
    announced = [[(2, 1, "pdf")], [(3, 505, "pdf"), (None, 500, None)], [(9, 590, "pdf"), (None, 600, None)], [(1, 650, "pdf"), (None, 700, None)]]
    got = _meeting(spark, tmp_path, arrived, announced)
    assert got == [(1, "", True), (2, "pdf", False), (3, "pdf", False), (4, "", True), (big, "", False)]


def test_ends_over_batches_need_no_python_state(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "analyzing"), (1, 3, "2024-01-01 00:00:02", "failed"), (1, 2, "2024-01-01 00:00:01", "completed"), (2, 4, "2024-01-01 00:00:03", "analyzing"), (1, 9, "2024-01-01 00:00:09", "failed")]
    batch, stream = _feed(spark, tmp_path, rows, 4)
    known = state.ends(stream)
    assert "InPandas" not in known._jdf.queryExecution().analyzed().toString()
    arrivals.run_updates_to_end(known, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {(r.scan_id, r.state, r.final_seq) for r in state.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {(r.scan_id, r.state, r.final_seq) for r in lifecycle.current_state(batch).collect()} == {(1, "completed", 2), (2, "analyzing", None)}
