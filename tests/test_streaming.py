import datetime as dt
import os

from pyspark.sql import functions as F

from trafficscore.operators.ratelimit import rate_limit_batch
from trafficscore.operators import rfm
from trafficscore.plans import views as V
from trafficscore.streaming.packets import stream_packet_tsv
from trafficscore.streaming.ratelimit import limiter_state, rate_limit_stream
from trafficscore.streaming.rfm import stream_rfm_raw, write_rfm_stream
from trafficscore.streaming.runner import drain
from conftest import SF001

SCHEMA = "request_id long, timestamp timestamp, client_ip string, path string"


def _write_files(spark, folder, reverse=True):
    """Access log split into 6 time-range files, written newest first (so a
    file stream delivers them out of event-time order), then a far-future
    flush row."""
    acc = V.access_log(spark, SF001).select("request_id", "timestamp", "client_ip", "path")
    acc = acc.withColumn("part", F.floor(F.dayofmonth("timestamp") / 6)).cache()
    parts = sorted(r.part for r in acc.select("part").distinct().collect())
    t = 1_700_000_000
    for i, p in enumerate(reversed(parts) if reverse else parts):
        d = os.path.join(folder, f"f{i}")
        acc.where(F.col("part") == p).drop("part").coalesce(1).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (t + i, t + i))
    flush = spark.createDataFrame([(-1, dt.datetime(2030, 1, 1), "flush", "/")], SCHEMA)
    d = os.path.join(folder, "zz")
    flush.coalesce(1).write.parquet(d)
    for f in os.listdir(d):
        os.utime(os.path.join(d, f), (t + 100, t + 100))
    return acc.drop("part")


def _stream(spark, folder, per_trigger=1):
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger)
            .option("recursiveFileLookup", "true").parquet(folder))


def _batch(acc):
    out = rate_limit_batch(acc, tie_col="request_id", window_seconds=86_400, limit=3)
    return {r.request_id: (r.request_count, r.over_limit) for r in out.collect()}


def test_event_time_out_of_order_equals_batch(spark, scratch):
    acc = _write_files(spark, os.path.join(scratch, "in"), reverse=True)
    lim = rate_limit_stream(_stream(spark, os.path.join(scratch, "in")), tie_col="request_id",
                            window_seconds=86_400, limit=3, mode="event_time", delay="40 days")
    out = os.path.join(scratch, "out")
    drain(lim.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck"))
          .trigger(availableNow=True).start(out))
    got = {r.request_id: (r.request_count, r.over_limit)
           for r in spark.read.parquet(out).where("request_id >= 0").collect()}
    assert got == _batch(acc)
    assert sum(o for _, o in got.values()) == 218


def test_groups_of_clients_share_calls_and_keep_their_windows(spark, scratch):
    """With ``groups`` there are as many states at most; NULL keys, and longs that differ beyond 2**53,
    are clients of their own; windows go on over batches."""
    acc = _write_files(spark, os.path.join(scratch, "in"), reverse=True)
    out = os.path.join(scratch, "out")
    lim = rate_limit_stream(_stream(spark, os.path.join(scratch, "in")), tie_col="request_id",
                            window_seconds=86_400, limit=3, mode="event_time", delay="40 days", groups=5)
    query = (lim.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck"))
             .trigger(availableNow=True).start(out))
    drain(query)
    got = {r.request_id: (r.request_count, r.over_limit)
           for r in spark.read.parquet(out).where("request_id >= 0").collect()}
    assert got == _batch(acc)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5

    big, landed, ck, out = 2**53, *(os.path.join(scratch, x) for x in ("in2", "ck2", "out2"))
    rows = [(None, 0, 1), (big, 0, 2), (big + 1, 1, 3), (big, 5, 4)], [(big, 30, 5), (None, 40, 6), (big, 61, 7)], [(0, 9999, -1)]
    for part in rows:
        (spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for k, s, i in part],
                               "user_id long, timestamp timestamp, rid long").coalesce(1).write.mode("append").parquet(landed))
        lim = rate_limit_stream(spark.readStream.schema("user_id long, timestamp timestamp, rid long").parquet(landed),
                                key_col="user_id", tie_col="rid", window_seconds=60, limit=1, mode="event_time",
                                delay="10 seconds", groups=2)
        drain(lim.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out))
    got = {r.rid: (r.user_id, r.request_count, r.over_limit) for r in spark.read.parquet(out).where("rid >= 0").collect()}
    assert got == {1: (None, 1, False), 2: (big, 1, False), 3: (big + 1, 1, False), 4: (big, 2, True), 5: (big, 3, True),
                   6: (None, 2, True), 7: (big, 1, False)}


def test_arrival_mode_in_order_equals_batch(spark, scratch):
    acc = _write_files(spark, os.path.join(scratch, "in"), reverse=False)
    lim = rate_limit_stream(_stream(spark, os.path.join(scratch, "in")), tie_col="request_id",
                            window_seconds=86_400, limit=3, mode="arrival")
    out = os.path.join(scratch, "out")
    with limiter_state(spark, drained=True):
        query = (lim.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck"))
                 .trigger(availableNow=True).start(out))
    drain(query)
    got = {r.request_id: (r.request_count, r.over_limit)
           for r in spark.read.parquet(out).where("request_id >= 0").collect()}
    assert got == _batch(acc)


def test_arrival_state_goes_on_over_restarts_and_ends(spark, scratch):
    """The window of a client goes on in the next run; state of clients not seen for its time to live is
    removed by the next batch.  NULL keys, and longs that differ beyond 2**53, are clients of their own."""
    import time
    big = 2**53
    landed, ck, out = (os.path.join(scratch, x) for x in ("in", "ck", "out"))

    def run(rows, **kw):
        (spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for k, s, i in rows],
                               "user_id long, timestamp timestamp, rid long").coalesce(1).write.mode("append").parquet(landed))
        lim = rate_limit_stream(spark.readStream.schema("user_id long, timestamp timestamp, rid long").parquet(landed),
                                key_col="user_id", tie_col="rid", window_seconds=60, limit=1, **kw)
        with limiter_state(spark, drained=True):
            q = lim.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        drain(q)
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    run([(None, 0, 1), (big, 0, 2), (big + 1, 1, 3), (big, 5, 4)])
    assert run([(big, 30, 5), (None, 40, 6), (big, 61, 7)]) == 3
    got = {r.rid: (r.user_id, r.request_count, r.over_limit) for r in spark.read.parquet(out).collect()}
    assert got == {1: (None, 1, False), 2: (big, 1, False), 3: (big + 1, 1, False), 4: (big, 2, True), 5: (big, 3, True),
                   6: (None, 2, True), 7: (big, 1, False)}
    # a time to live of one second of processing time: after it, one client's state is left
    landed, ck, out = (os.path.join(scratch, x) for x in ("in2", "ck2", "out2"))
    assert run([(1, 0, 1), (2, 0, 2), (3, 1, 3)], lag_seconds=-59) == 3
    time.sleep(2)
    assert run([(7, 90, 8)], lag_seconds=-59) == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider


def test_event_time_holds_back_until_watermark(spark, scratch):
    """Without the flush row the newest day of data stays buffered."""
    folder = os.path.join(scratch, "in")
    acc = _write_files(spark, folder, reverse=False)
    lim = rate_limit_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                            .option("pathGlobFilter", "*.parquet").parquet(os.path.join(folder, "f*")),
                            tie_col="request_id", window_seconds=86_400, limit=3, mode="event_time",
                            delay="1 day")
    out = os.path.join(scratch, "out")
    drain(lim.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck"))
          .trigger(availableNow=True).start(out))
    n = spark.read.parquet(out).count()
    newest = acc.agg(F.max("timestamp")).first()[0]
    held = acc.where(F.col("timestamp") > F.lit(newest - dt.timedelta(days=1))).count()
    assert 0 < n <= acc.count() - held


def test_running_rfm_equals_batch(spark, scratch):
    acc = _write_files(spark, os.path.join(scratch, "in"))
    s = _stream(spark, os.path.join(scratch, "in"), per_trigger=2).where("request_id >= 0")
    out = os.path.join(scratch, "rfm")
    drain(write_rfm_stream(stream_rfm_raw(s, monetary_col=None), out, os.path.join(scratch, "ck"),
                           now="2024-01-31 00:00:00", trigger={"availableNow": True}))
    got = {r.client_ip: (round(r.recency_days, 9), r.frequency) for r in spark.read.parquet(out).collect()}
    want = {r.client_ip: (round(r.recency_days, 9), r.frequency)
            for r in rfm.compute_rfm(acc, "2024-01-31 00:00:00", monetary_col=None).collect()}
    assert got == want


def test_packet_converter_stream(spark, scratch):
    src = os.path.join(scratch, "tsv")
    V.packet_lines(spark, SF001).select("value").coalesce(2).write.text(src)
    from trafficscore.streaming.packets import read_packet_tsv_stream
    lines = read_packet_tsv_stream(spark, src, max_files_per_trigger=1)
    out = os.path.join(scratch, "csv")
    q = stream_packet_tsv(lines, out, os.path.join(scratch, "ck"), trigger={"availableNow": True})
    drain(q)
    seen = {}
    for p in q.recentProgress:
        for k, v in (p.observedMetrics.get("packet_lines") or {}).asDict().items():
            seen[k] = seen.get(k, 0) + (v or 0)
    back = spark.read.option("header", "true").csv(out)
    assert seen["ok"] == back.count() and seen["malformed"] > 0 and seen["missing"] > 0 and seen["skip"] > 0
    assert back.columns == ["timestamp", "src_ip", "pkt_len", "rotation"]
    from trafficscore.sources.logs import read_packet_tsv
    assert back.count() == read_packet_tsv(spark.read.text(src)).count()
    assert back.where(~F.col("rotation").startswith("netlog_")).count() == 0


def test_access_log_stream_sink(spark, scratch):
    from trafficscore.streaming.packets import stream_access_log
    folder = os.path.join(scratch, "in")
    _write_files(spark, folder)
    out = os.path.join(scratch, "log")
    drain(stream_access_log(_stream(spark, folder, per_trigger=3), out, os.path.join(scratch, "ck"),
                            trigger={"availableNow": True}))
    back = spark.read.option("header", "true").csv(out)
    assert back.columns == ["request_id", "timestamp", "client_ip", "path"]
    assert back.count() == 1001          # every request plus the flush row


def test_event_time_reports_rows_later_than_the_watermark(spark, scratch):
    from trafficscore.streaming.ratelimit import rows_dropped_by_watermark
    folder = os.path.join(scratch, "in")
    t0 = dt.datetime(2024, 1, 10)
    # the late-row filter uses the watermark of the previous batch, so a
    # middle batch moves it before the late file arrives
    for i, rows in enumerate([[(1, t0, "a"), (2, t0 + dt.timedelta(days=2), "a")],
                              [(5, t0 + dt.timedelta(days=2, minutes=1), "a")],
                              [(3, t0 - dt.timedelta(days=1), "a"), (4, t0 + dt.timedelta(hours=1), "a")]]):
        d = os.path.join(folder, f"f{i}")
        spark.createDataFrame([(r, t, c, "/") for r, t, c in rows], SCHEMA).coalesce(1).write.parquet(d)
        for f in os.listdir(d):
            os.utime(os.path.join(d, f), (1_700_000_000 + i, 1_700_000_000 + i))
    lim = rate_limit_stream(_stream(spark, folder), tie_col="request_id", window_seconds=60, limit=10,
                            mode="event_time", delay="1 hour")
    q = (lim.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start(os.path.join(scratch, "out")))
    drain(q)
    assert rows_dropped_by_watermark(q) == 2
    # arrival mode keeps every row
    lim2 = rate_limit_stream(_stream(spark, folder), tie_col="request_id", window_seconds=60, limit=10)
    out2 = os.path.join(scratch, "out2")
    with limiter_state(spark, drained=True):
        q2 = (lim2.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck2"))
              .trigger(availableNow=True).start(out2))
    drain(q2)
    assert spark.read.parquet(out2).count() == 5


def test_converter_start_time(spark, scratch):
    """A file source has no 'start at the end'; start_ts skips older packets."""
    src = os.path.join(scratch, "tsv")
    V.packet_lines(spark, SF001).select("value").coalesce(1).write.text(src)
    out = os.path.join(scratch, "csv")
    start = "2024-01-20 00:00:00"
    drain(stream_packet_tsv(spark.readStream.format("text").load(src), out, os.path.join(scratch, "ck"),
                            trigger={"availableNow": True}, start_ts=start))
    back = spark.read.option("header", "true").csv(out)
    assert back.count() > 0
    assert back.where(F.col("timestamp").cast("timestamp") < F.lit(start).cast("timestamp")).count() == 0
    from trafficscore.sources.logs import read_packet_tsv
    want = read_packet_tsv(spark.read.text(src)).where(F.col("timestamp") >= F.lit(start).cast("timestamp")).count()
    assert back.count() == want


def test_stream_landing_is_pruned_by_the_mark(spark, scratch):
    from trafficscore.operators.clean import filter_since
    from trafficscore.streaming.packets import stream_land_logs
    folder = os.path.join(scratch, "in")
    acc = _write_files(spark, folder)
    landed = os.path.join(scratch, "landed")
    drain(stream_land_logs(_stream(spark, folder, per_trigger=3), landed, os.path.join(scratch, "ck"),
                           trigger={"availableNow": True}))
    back = spark.read.parquet(landed)
    assert back.count() == acc.count() + 1                     # every request plus the flush row
    q = filter_since(back, "2024-01-25 00:00:00", partition_col="date")
    assert "PartitionFilters: [isnotnull(date" in q._jdf.queryExecution().executedPlan().toString()
    assert q.count() == filter_since(acc, "2024-01-25 00:00:00").count() + 1
