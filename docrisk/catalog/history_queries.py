"""Queries on history, lifecycle, overrides, outbound checks, metrics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrisk.catalog.core import query
from docrisk.catalog.scan_queries import _SCAN, _TEXT, FORMATS, LEVEL, all_tables, full_scan, lines_of
from docrisk.catalog.views import Inputs
from docrisk.functions import patterns as P
from docrisk.operators import control, evidence, history, lifecycle
from docrisk.session import work_folder
from docrisk.sources import sinks
from docrisk.streaming import arrivals, scans, state

_LVL = LEVEL.replace("{s}", "risk_score")
_TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
SCANS = f"with s as (select *, {_LVL} as risk_level from {{fx_scans}}) "


def _scans(x: Inputs) -> DataFrame:
    return history.with_level(x.fx_scans)


def _ts(col: str = "created_at"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query(
    "history_valid_request", "L-1",
    r"""with r as (select doc_id, case when doc_id % 3 = 0 then concat('  ', h[1:8], '-', h[9:12], '-4', h[14:16], '-a', h[18:20], '-', h[21:32], ' ') when doc_id % 3 = 1
      then concat(h[1:8], '-', h[9:12], '-7', h[14:16], '-a', h[18:20], '-', h[21:32]) else h end as request_id from (select doc_id, sha256(text) as h from {documents}))
    select doc_id, case when regexp_matches(trim(request_id), '(?i)"""
    + P.REQUEST_ID.replace("{", "{{").replace("}", "}}")
    + "') then trim(request_id) end as clean_request_id from r",
)
def valid_request(x: Inputs) -> DataFrame:
    h = "sha2(text, 256)"
    part = lambda a, n: f"substring({h}, {a}, {n})"
    shaped = lambda v: f"concat({part(1, 8)}, '-', {part(9, 4)}, '-{v}', {part(14, 3)}, '-a', {part(18, 3)}, '-', {part(21, 12)})"
    made = x.documents.selectExpr(
        "doc_id", f"case when doc_id % 3 = 0 then concat('  ', {shaped(4)}, ' ') when doc_id % 3 = 1 then {shaped(7)} else {h} end as request_id"
    )
    return lifecycle.valid_request(made).select("doc_id", "clean_request_id")


@query(
    "history_first_per_request", "L-2",
    """select scan_id, seq, user_id, request_id from {fx_lifecycle} where request_id is null
    union all select scan_id, seq, user_id, request_id from {fx_lifecycle} where request_id is not null qualify row_number() over (partition by user_id, request_id order by seq) = 1""",
)
def first_per_request(x: Inputs) -> DataFrame:
    return lifecycle.first_per_request(x.fx_lifecycle).select("scan_id", "seq", "user_id", "request_id")


_STORE = "select * from {fx_lifecycle} where scan_id % 3 <> 0 and request_id is not null"
_BATCH = "select * from {fx_lifecycle} where scan_id % 3 = 0 or scan_id % 7 = 0"


@query(
    "history_new_requests", "L-3",
    f"""with st as ({_STORE}), b as ({_BATCH}) select scan_id, seq from b where request_id is null
      or not exists (select 1 from st where st.user_id = b.user_id and st.request_id = b.request_id)""",
)
def new_requests(x: Inputs) -> DataFrame:
    return lifecycle.new_requests(x.sql(_BATCH), x.sql(_STORE)).select("scan_id", "seq")


@query(
    "history_replies", "L-3",
    f"""with st as ({_STORE}), b as ({_BATCH}), k as (select user_id, request_id, min(scan_id) as stored_scan_id from st group by 1, 2)
    select b.seq, k.stored_scan_id from b join k on k.user_id = b.user_id and k.request_id = b.request_id""",
)
def replies(x: Inputs) -> DataFrame:
    return lifecycle.replies(x.sql(_BATCH), x.sql(_STORE)).select("seq", "stored_scan_id")


_STATE = """select scan_id, coalesce(arg_min(state, seq) filter (state in ('completed', 'failed')), 'analyzing') as state,
 min(seq) filter (state in ('completed', 'failed')) as final_seq from {fx_lifecycle} group by scan_id"""


@query("history_current_state", "L-4", _STATE)
def current_state(x: Inputs) -> DataFrame:
    return lifecycle.current_state(x.fx_lifecycle).drop("events")


@query(
    "history_failed_messages", "L-4",
    f"with c as ({_STATE}) select scan_id, state, case when state = 'failed' then case when scan_id % 2 = 0 then 'timeout' else 'File analysis failed.' end end as error_message from c",
)
def failed_messages(x: Inputs) -> DataFrame:
    states = lifecycle.current_state(x.fx_lifecycle).withColumn("error_message", F.when(F.col("scan_id") % 2 == 0, F.lit("timeout")))
    return lifecycle.failed_messages(states).select("scan_id", "state", "error_message")


@query("history_for_user", "L-5", SCANS + f"select scan_id, {_TS} as created, risk_level from s where user_id = 7 order by created_at desc, scan_id desc")
def for_user(x: Inputs) -> DataFrame:
    return history.for_user(_scans(x), 7).select("scan_id", _ts().alias("created"), "risk_level")


@query("history_recent", "L-6", "select user_id, scan_id, row_number() over (partition by user_id order by created_at desc, scan_id desc) as recency from {fx_scans} qualify recency <= 5")
def recent(x: Inputs) -> DataFrame:
    return history.recent(x.fx_scans).select("user_id", "scan_id", F.col("recency").cast("bigint").alias("recency"))


@query("history_search", "L-7", SCANS + "select scan_id, filename, risk_level from s where contains(lower(filename), 'click-1') and risk_level = 'low'")
def search(x: Inputs) -> DataFrame:
    return history.search(_scans(x), "  CLICK-1 ", "low").select("scan_id", "filename", "risk_level")


@query("history_counts", "L-8", SCANS + "select count(*) filter (contains(lower(filename), 'click')) as shown, count(*) as total from s")
def counts(x: Inputs) -> DataFrame:
    return history.counts(_scans(x), "click", "all")


_STORED = "select s.scan_id, s.user_id, s.filename, s.risk_score, case when s.scan_id % 5 = 0 then 'failed' when s.scan_id % 7 = 0 then 'analyzing' else 'completed' end as status, cast(null as {str}) as error_message from {{fx_scans}} s"


@query(
    "history_get", "L-9",
    "with t as (" + _STORED.replace("{str}", "varchar").replace("{{", "{").replace("}}", "}") + """)
    select scan_id, status, case when status = 'completed' then filename end as filename, case when status = 'completed' then risk_score end as risk_score,
      case when status = 'failed' then 'File analysis failed.' end as error from t where user_id in (3, 17, 40) or user_id = 5 and scan_id = 10""",
)
def get(x: Inputs) -> DataFrame:
    """All scans of three owners, in all states, and one scan as another owner asks for it."""
    stored = x.sql(_STORED.replace("{str}", "string").replace("{{", "{").replace("}}", "}"))
    return history.get(stored, 3).unionByName(history.get(stored, 17)).unionByName(history.get(stored, 40)).unionByName(history.get(stored, 5, 10))


@query("history_records", "L-10", SCANS + f"select scan_id as id, filename as name, {_TS} as scanned_at, risk_level as risk from s")
def records(x: Inputs) -> DataFrame:
    return history.records(_scans(x)).withColumn("scanned_at", _ts("scanned_at"))


@query(
    "history_format_date", "L-11",
    """select scan_id, case when scan_id % 11 = 0 then 'Unknown' else strftime(created_at, '%d/%m/%Y') end as eu, case when scan_id % 11 = 0 then 'Unknown' else strftime(created_at, '%m/%d/%Y') end as us,
    case when scan_id % 11 = 0 then 'Unknown' else strftime(created_at, '%Y-%m-%d') end as iso from {fx_scans}""",
)
def format_date(x: Inputs) -> DataFrame:
    raw = F.when(F.col("scan_id") % 11 == 0, F.lit("not a date")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return x.fx_scans.select(
        "scan_id", history.format_date(raw).alias("eu"), history.format_date(raw, "MM/DD/YYYY").alias("us"), history.format_date(raw, "YYYY-MM-DD").alias("iso")
    )


@query(
    "history_to_result", "L-12",
    SCANS + """select scan_id, filename, 'sha256' as hash_algorithm, 'clamav' as av_engine, case when scan_id % 2 = 0 then 'clean' else 'error' end as av_status, '' as av_details,
      false as extension_mismatch, risk_score, risk_level from s""",
)
def to_result(x: Inputs) -> DataFrame:
    stored = _scans(x).withColumn("av_status", F.when(F.col("scan_id") % 2 == 0, F.lit("clean")))
    return history.to_result(stored).select(
        "scan_id", "filename", "hash_algorithm", "av_engine", "av_status", "av_details", "extension_mismatch", "risk_score", "risk_level"
    )


@query(
    "history_display", "L-17",
    """select scan_id, case when scan_id % 4 = 0 then 0 else greatest(0, least(100, risk_score * 3 - 60)) end as shown_score, case when scan_id % 3 = 0 then 'unknown' else 'low' end as shown_level,
    case when scan_id % 5 = 0 then 'review' else 'allow' end as shown_verdict, case when scan_id % 2 = 0 then 2 else 0 end as evidence_count from {fx_scans}""",
)
def display(x: Inputs) -> DataFrame:
    nth = lambda n, v: F.when(F.col("scan_id") % n != 0, v)
    given = x.fx_scans.select(
        "scan_id", nth(4, F.col("risk_score") * 3 - 60).alias("risk_score"), nth(3, F.lit("low")).alias("risk_level"), nth(5, F.lit("allow")).alias("verdict"),
        F.when(F.col("scan_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("evidence"),
    )
    return history.display(given).select("scan_id", "shown_score", "shown_level", "shown_verdict", "evidence_count")


# ---- overrides ----------------------------------------------------------------------------------
JUDGED = """with p as (select event_id, min(seq) as t0 from {fx_override} where state = 'PENDING_APPROVAL' group by 1),
d as (select o.event_id, min(o.seq) as t1, arg_min(o.state, o.seq) as decision from {fx_override} o join p on p.event_id = o.event_id
  where o.state in ('APPROVED', 'REJECTED') and o.seq > t0 and o.actor <> o.owner group by 1),
r as (select o.event_id, min(o.seq) as t2 from {fx_override} o join d on d.event_id = o.event_id where o.state = 'RELEASED' and decision = 'APPROVED' and o.seq > t1 group by 1),
j as (select o.*, coalesce(o.seq = t0, false) or coalesce(o.seq = t1, false) or coalesce(o.seq = t2, false) as legal from {fx_override} o
  left join p on p.event_id = o.event_id left join d on d.event_id = o.event_id left join r on r.event_id = o.event_id) """


@query("control_lifecycle", "L-13", JUDGED + "select event_id, seq, state, actor, legal from j")
def control_lifecycle(x: Inputs) -> DataFrame:
    return control.lifecycle(x.fx_override).select("event_id", "seq", "state", "actor", "legal")


@query("control_current", "L-13", JUDGED + "select event_id, arg_max(state, seq) filter (legal) as state, count(*) filter (not legal) as violations from j group by event_id")
def control_current(x: Inputs) -> DataFrame:
    return control.current(control.lifecycle(x.fx_override))


@query("control_audit", "L-14", JUDGED + "select event_id, seq, actor, state, case when legal then 'applied' else 'refused' end as outcome from j")
def control_audit(x: Inputs) -> DataFrame:
    path = work_folder(x.spark, "audit") + "/log"
    control.write_audit(control.lifecycle(x.fx_override), path)
    return x.spark.read.parquet(path)


# ---- stored scans and streams -------------------------------------------------------------------
@query("scan_stored", "IO-4, L-12, V-9", "select file_id as scan_id, risk_score, risk_level, verdict from (" + _SCAN + ")")
def scan_stored(x: Inputs) -> DataFrame:
    """The whole scan written as a table with typed facts and evidence, and read back as a list view."""
    path = work_folder(x.spark, "results") + "/table"
    rows = full_scan(x).withColumnRenamed("file_id", "scan_id").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    sinks.write_scans(rows, path)
    return x.spark.read.parquet(path).select("scan_id", "risk_score", "risk_level", "verdict")


@query(
    "scan_evidence_ids", "EV-1",
    SCANS + "select scan_id, sha256(concat(cast(scan_id as varchar), '/G-2')) as evidence_id from s where risk_level = 'critical'",
)
def scan_evidence_ids(x: Inputs) -> DataFrame:
    """Evidence ids are a function of scan and rule."""
    hot = _scans(x).withColumn("av_status", F.when(F.col("risk_level") == "critical", F.lit("threat"))).withColumn("av_details", F.lit("x"))
    return evidence.apply_rules(hot, evidence.GENERIC[1:2], "scan_id").select("scan_id", "evidence_id")


def _files(x: Inputs) -> int:
    return int(x.spark.conf.get("spark.sql.shuffle.partitions"))


def _events_folder(x: Inputs, name: str) -> tuple[str, str]:
    """Lifecycle events as a folder of as many files as the cluster shuffles in, and a checkpoint folder."""
    root = work_folder(x.spark, name)
    x.fx_lifecycle.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(_files(x), "seq").write.parquet(f"{root}/in")
    return root, f"{root}/in"


_FIRST = """select user_id, request_id, cast(null as bigint) as seq from {fx_lifecycle} where request_id is not null group by 1, 2
union all select user_id, request_id, seq from {fx_lifecycle} where request_id is null"""


@query("stream_first_requests", "S-2", _FIRST)
def stream_first_requests(x: Inputs) -> DataFrame:
    root, path = _events_folder(x, "dedup")
    stream = arrivals.read_folder(x.spark, path, x.spark.read.parquet(path).schema)
    arrivals.run_to_end(arrivals.first_requests(stream, horizon="36500 days"), f"{root}/out", f"{root}/progress")
    # Which of several equal requests of a batch comes first is open, so only rows without id show their number.
    return x.spark.read.parquet(f"{root}/out").select("user_id", "request_id", F.when(F.col("request_id").isNull(), F.col("seq")).alias("seq"))


@query(
    "stream_new_requests", "S-2, L-3",
    """select user_id, request_id, min(seq) as seq from {fx_lifecycle} where request_id is not null group by 1, 2
    union all select user_id, request_id, seq from {fx_lifecycle} where request_id is null""",
)
def stream_new_requests(x: Inputs) -> DataFrame:
    root, path = _events_folder(x, "store")
    stream = arrivals.read_folder(x.spark, path, x.spark.read.parquet(path).schema)
    run = (
        stream.writeStream.foreachBatch(arrivals.store_new_requests(f"{root}/store"))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return x.spark.read.parquet(f"{root}/store").select("user_id", "request_id", "seq")


@query("stream_lifecycle", "S-3, S-4", _STATE)
def stream_lifecycle(x: Inputs) -> DataFrame:
    root, path = _events_folder(x, "state")
    stream = arrivals.read_folder(x.spark, path, x.spark.read.parquet(path).schema)
    arrivals.run_updates_to_end(state.ends(stream), f"{root}/out", f"{root}/progress")
    return state.current(x.spark.read.parquet(f"{root}/out"))


@query("stream_text_scan", "S-1, V-9", _TEXT + f" select doc_id, av as av_status, cast(s as int) as risk_score, {LEVEL.replace('{s}', 's')} as risk_level from r")
def stream_text_scan(x: Inputs) -> DataFrame:
    """Seeded documents arriving in files, scored by the function the batch query uses."""
    root = work_folder(x.spark, "arrivals")
    x.fx_seeded.repartition(_files(x), "doc_id").write.parquet(f"{root}/in")
    stream = arrivals.read_folder(x.spark, f"{root}/in", x.fx_seeded.schema)
    scored = arrivals.score(stream, x.fx_av).select("doc_id", "av_status", "risk_score", "risk_level")
    arrivals.run_to_end(scored, f"{root}/out", f"{root}/progress")
    return x.spark.read.parquet(f"{root}/out")


# Tables whose rows are a format's facts, with their key.
_FACT_TABLES = {
    "pdf": (("fx_pdf_objects", "doc_id"), ("fx_pdf_spans", "doc_id"), ("fx_pdf_pages", "doc_id")),
    "exe": (("fx_pe_headers", "file_id"),),
    "docx": (("fx_ooxml_full", "doc_id"),),
    "json": (("fx_json_docs", "doc_id"),),
}
_START = "timestampadd(second, file_id, timestamp '2024-01-01')"


def scan_feeds(x: Inputs, root: str) -> tuple[DataFrame, DataFrame]:
    """Arrivals of all files and announcements of their facts as streams; a heartbeat a day later ends each."""
    beat = "select cast(null as bigint) as file_id, max(ts) + interval 1 day as ts, cast(null as string) as {c} from {t}"
    came = scans.wanted(x.fx_files, FORMATS).selectExpr("cast(file_id as bigint) as file_id", f"{_START} as ts", "wanted")
    given, x = None, x.with_table("lineitem", lines_of(x, x.fx_files.select("file_id")))
    for name, sources in _FACT_TABLES.items():
        for table, key in sources:
            part = x[table].select(F.col(key).cast("bigint").alias("file_id"), F.lit(name).alias("format")).distinct()
            given = part if given is None else given.union(part)
    told = given.join(x.fx_files.select("file_id"), "file_id", "left_semi").distinct().selectExpr("file_id", f"timestampadd(second, file_id % 50, {_START}) as ts", "format")
    feeds = []
    for name, rows, last in (("arrived", came, "wanted"), ("announced", told, "format")):
        end = x.spark.sql(beat.format(c=last, t="{t}"), t=came.select("ts"))
        rows.repartitionByRange(_files(x), "ts").unionByName(end).write.parquet(f"{root}/{name}")
        feeds.append(arrivals.read_folder(x.spark, f"{root}/{name}", rows.schema))
    return feeds[0], feeds[1]


@query("stream_scan", "S-1, V-9", _SCAN)
def stream_scan(x: Inputs) -> DataFrame:
    """The whole scan of files that arrive, with facts announced up to 49 seconds later or never; a file waits a minute."""
    root = work_folder(x.spark, "scan")
    shown = ("file_id", "detected_type", "av_status", "risk_score", "risk_level", "verdict")
    ready = scans.ready(*scan_feeds(x, root), delay="2 minutes", timeout_ms=60_000)
    run = (
        ready.writeStream.foreachBatch(scans.decide(x.fx_files, x.fx_av, lambda ids: all_tables(x, ids), FORMATS, root, shown))
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return x.spark.read.parquet(f"{root}/results").select(*shown)
