import datetime as dt
import os

from pyspark.sql import functions as F

from trafficscore.operators import clean, score
from trafficscore.plans import jobs, views as V
from trafficscore.sources import hwm as H, logs as S, sinks as K
from conftest import SF001

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def _write_access_csv(spark, path):
    a = V.access_log(spark, SF001)
    text = a.select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "client_ip",
                    "src_port", "method", "path", F.col("http_body_length").cast("string").alias("http_body_length"),
                    "user_agent", "referer")
    K.append_access_log(text, path)
    return a


def _write_packet_csv(spark, path):
    ok = S.parse_packet_lines(V.packet_lines(spark, SF001)).where(F.col("kind") == "ok")
    slim = clean.slim_packets(ok).select("timestamp", "src_ip", "pkt_len")
    slim.write.mode("overwrite").option("header", "true").csv(path)
    return slim


def test_refresh_rfm_roundtrip(spark, scratch):
    logs = os.path.join(scratch, "network_logs")
    src = _write_access_csv(spark, logs)
    out = os.path.join(scratch, "rfm_scores")
    n = jobs.refresh_rfm(spark, logs, out, now=NOW)
    want = src.where(~F.col("path").startswith("/static")).select("client_ip").distinct().count()
    assert n == want
    back = S.read_rfm_table(spark, out)
    assert back.count() == want and back.columns == ["client_ip", "recency_days", "frequency", "monetary"]
    assert jobs.refresh_rfm(spark, src.limit(0), os.path.join(scratch, "empty"), now=NOW) == 0


def test_run_incremental_and_hwm(spark, scratch):
    logs = os.path.join(scratch, "netlogs")
    n_ips = _write_packet_csv(spark, logs).select("src_ip").distinct().count()
    out = os.path.join(scratch, "outputs")
    mark = os.path.join(scratch, "last_run")
    assert H.load_high_water_mark(spark, mark) == H.EPOCH
    path = jobs.run_incremental(spark, logs, out, mark, now=NOW)
    assert path.endswith("rfm_scores_20240131T000000Z.csv")
    snap = spark.read.option("header", "true").csv(path)
    assert snap.count() == n_ips and snap.columns == ["src_ip", "r_score", "f_score", "m_score",
                                                    "composite_score", "last_updated"]
    assert [r.src_ip for r in snap.collect()] == sorted(r.src_ip for r in snap.collect())
    assert H.load_high_water_mark(spark, mark) == NOW
    # nothing newer than the mark: no output, mark unchanged
    assert jobs.run_incremental(spark, logs, out, mark, now=NOW + dt.timedelta(hours=1)) is None
    assert H.load_high_water_mark(spark, mark) == NOW


def test_event_max_mark(spark, scratch):
    logs = os.path.join(scratch, "netlogs")
    slim = _write_packet_csv(spark, logs)
    mark = os.path.join(scratch, "mark")
    jobs.run_incremental(spark, logs, os.path.join(scratch, "o"), mark, now=NOW, hwm="event_max")
    newest = slim.agg(F.max(F.col("timestamp").try_cast("timestamp"))).first()[0]
    assert H.load_high_water_mark(spark, mark).replace(tzinfo=None) == newest


def test_sinks(spark, scratch):
    scores = spark.createDataFrame([("b", 1, 2, 3, 123.0, "t"), ("a", 5, 0, 0, 500.0, "t")],
                                   "src_ip string, r_score int, f_score int, m_score int, composite_score float, "
                                   "last_updated string")
    j = K.scores_for_jdbc(scores)
    assert [f.dataType.simpleString() for f in j.schema.fields] == ["string", "float", "float", "float", "float",
                                                                     "string"]
    p = K.write_scores_snapshot(scores, scratch, NOW, single_file=True)
    assert len([f for f in os.listdir(p) if f.startswith("part-")]) == 1
    assert [r.src_ip for r in spark.read.option("header", "true").csv(p).collect()] == ["a", "b"]
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), 1), (dt.datetime(2024, 1, 1, 1, 5), 2)],
                               "timestamp timestamp, v int")
    K.sink_rotating_csv(ev, os.path.join(scratch, "rot"))
    assert sorted(os.listdir(os.path.join(scratch, "rot")))[-2:] == ["rotation=netlog_20240101_000000",
                                                                      "rotation=netlog_20240101_010000"]


def test_merge_scores(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "src_ip string, r_score int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "src_ip string, r_score int")
    got = {r.src_ip: r.r_score for r in score.merge_scores(old, new).collect()}
    assert got == {"a": 1, "b": 9, "c": 3}


def test_released_after_drops_cached_tables(spark):
    from trafficscore.plans.strategies import materialize, released_after
    with released_after():
        df = materialize(spark.range(100))
        df.count()
        assert df.is_cached
    assert not df.is_cached


def test_empty_log_folder(spark, scratch):
    empty = os.path.join(scratch, "none")
    os.makedirs(empty)
    assert jobs.refresh_rfm(spark, empty, os.path.join(scratch, "out"), now=NOW) == 0


def test_config_from_env_and_job(spark, scratch):
    from trafficscore.config import JobConfig, from_env
    cfg = from_env({"IP_COLUMN": "client_ip", "INTERVAL_SECONDS": "60", "MONETARY_COLUMN": ""})
    assert cfg.interval_seconds == 60 and cfg.monetary_col is None and cfg.output_file == "rfm_scores.csv"
    assert JobConfig().composite_threshold == 400.0 and JobConfig().last_run_file == "last_run.txt"
    logs = os.path.join(scratch, "network_logs")
    _write_access_csv(spark, logs)
    out = os.path.join(scratch, "rfm.csv")
    n = jobs.refresh_from_config(spark, cfg.with_(network_log_dir=logs, output_file=out), now=NOW)
    back = S.read_rfm_table(spark, out)
    assert n == back.count() and "monetary" not in [c for c in spark.read.option("header", "true").csv(out).columns]


def test_decide_job_end_to_end(spark, scratch):
    logs = os.path.join(scratch, "network_logs")
    src = _write_access_csv(spark, logs)
    table = os.path.join(scratch, "rfm_scores")
    jobs.refresh_rfm(spark, logs, table, now=NOW)
    out = os.path.join(scratch, "decisions")
    n = jobs.decide_job(spark, logs, table, out, window_seconds=86_400, limit=3,
                        verdict_kw=dict(max_recency_days=1, freq_pct=50, low_monetary=1800, high_monetary=3000))
    back = spark.read.parquet(out)
    assert back.count() == src.where(F.col("path") == "/sensitive-data").count()
    assert n == back.where(F.col("decision") == "challenge").count()


def test_read_logs_formats(spark, scratch):
    from trafficscore.schemas import RFM_RAW_SCHEMA
    rfm_df = spark.createDataFrame([("1.1.1.1", 0.5, 3, 10.0), ("2.2.2.2", 1.5, 7, 0.0)], RFM_RAW_SCHEMA)
    for fmt in ("parquet", "json", "orc", "csv"):
        path = os.path.join(scratch, f"rfm_{fmt}")
        K.write_rfm_table(rfm_df, path, fmt=fmt)
        back = S.read_logs(spark, path, fmt=fmt, schema=RFM_RAW_SCHEMA if fmt in ("csv", "json") else None)
        assert sorted(tuple(r) for r in back.select(*RFM_RAW_SCHEMA.fieldNames()).collect()) == \
            sorted(tuple(r) for r in rfm_df.collect()), fmt
    assert S.read_rfm_table(spark, os.path.join(scratch, "rfm_parquet"), fmt="parquet").count() == 2


def test_incremental_over_landed_parquet(spark, scratch):
    from trafficscore.sources.sinks import land_logs
    ok = S.parse_packet_lines(V.packet_lines(spark, SF001)).where(F.col("kind") == "ok")
    slim = clean.slim_packets(ok).select("timestamp", "src_ip", "pkt_len")
    landed = os.path.join(scratch, "landed")
    land_logs(clean.clean_packets(slim), landed)
    csv = os.path.join(scratch, "csv")
    slim.write.option("header", "true").csv(csv)
    mark_a, mark_b = os.path.join(scratch, "ma"), os.path.join(scratch, "mb")
    since = dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
    H.save_high_water_mark(spark, mark_a, since)
    H.save_high_water_mark(spark, mark_b, since)
    pa = jobs.run_incremental(spark, landed, os.path.join(scratch, "oa"), mark_a, now=NOW, fmt_in="parquet")
    pb = jobs.run_incremental(spark, csv, os.path.join(scratch, "ob"), mark_b, now=NOW)
    a = sorted(tuple(r) for r in spark.read.option("header", "true").csv(pa).collect())
    b = sorted(tuple(r) for r in spark.read.option("header", "true").csv(pb).collect())
    assert a == b and len(a) > 0


def test_refresh_over_landed_parquet(spark, scratch):
    from trafficscore.sources.sinks import land_logs
    logs = os.path.join(scratch, "network_logs")
    src = _write_access_csv(spark, logs)
    landed = os.path.join(scratch, "landed")
    land_logs(src, landed)
    a = jobs.refresh_rfm(spark, logs, os.path.join(scratch, "a"), now=NOW)
    b = jobs.refresh_rfm(spark, landed, os.path.join(scratch, "b"), now=NOW, fmt_in="parquet")
    ra = sorted(tuple(r) for r in S.read_rfm_table(spark, os.path.join(scratch, "a")).collect())
    rb = sorted(tuple(r) for r in S.read_rfm_table(spark, os.path.join(scratch, "b")).collect())
    assert a == b and [(x[0], x[2]) for x in ra] == [(x[0], x[2]) for x in rb]


def test_command_line(spark, scratch, monkeypatch, capsys):
    from trafficscore.__main__ import main
    logs = os.path.join(scratch, "network_logs")
    _write_access_csv(spark, logs)
    out = os.path.join(scratch, "rfm.csv")
    monkeypatch.setenv("NETWORK_LOG_DIR", logs)
    monkeypatch.setenv("OUTPUT_FILE", out)
    assert main(["refresh"]) == 0
    assert "RFM table saved" in capsys.readouterr().out
    dec = os.path.join(scratch, "dec")
    assert main(["decide", logs, out, dec, "--window", "86400", "--limit", "3"]) == 0
    assert spark.read.parquet(dec).count() > 0
