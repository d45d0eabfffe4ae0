import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficscore.functions import scalars as X
from trafficscore.operators import clean
from trafficscore.sources import logs as S

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)


def _ts(d):
    return d.isoformat()


def test_dirty_packet_rows(spark):
    rows = [
        (_ts(NOW), "192.168.1.10", "100"),
        (_ts(NOW - dt.timedelta(seconds=10)), "192.168.1.11", "500"),
        (_ts(NOW - dt.timedelta(minutes=5)), "192.168.1.10", "120"),
        (_ts(NOW - dt.timedelta(hours=1)), "10.0.0.5", "1480"),
        (_ts(NOW - dt.timedelta(days=1)), "192.168.1.10", "80"),
        (_ts(NOW - dt.timedelta(days=2)), "10.0.0.5", "1400"),
        ("invalid-timestamp", "10.0.0.6", "100"),
        (_ts(NOW), None, "200"),
        (_ts(NOW), "10.0.0.7", "-1"),
        (_ts(NOW), "10.0.0.7", "abc"),
    ]
    df = spark.createDataFrame(rows, "timestamp string, src_ip string, pkt_len string")
    out = clean.clean_packets(df).collect()
    assert len(out) == 6
    assert {r.src_ip for r in out} == {"192.168.1.10", "192.168.1.11", "10.0.0.5"}
    since = clean.clean_packets(df, since=NOW - dt.timedelta(hours=1)).collect()
    assert len(since) == 3          # strictly newer than the mark


def test_packet_lines(spark):
    good = "2024-05-01 12:00:00.000001\t10.0.0.1\t10.0.0.2\t6\t1234\t80\t60\t-A--S-"
    lines = [
        (1, "Timestamp\tSrcIP\tDstIP\tProto\tSrcPort\tDstPort\tLength\tFlags"),
        (2, "# Log Started at 2024-05-01"),
        (3, ""),
        (4, "   " + good + "  \n"),
        (5, "2024-05-01 12:00:00.000001\t10.0.0.1\t10.0.0.2\t6\t1234\t80\t60"),
        (6, "2024-05-01 12:00:00.000001\t\t10.0.0.2\t17\t1234\t53\t60\t-"),
        (7, "2024-05-01 12:00:00.000001\t10.0.0.1\t10.0.0.2\t17\t1234\t53\t60\t"),
    ]
    df = spark.createDataFrame(lines, "line_id int, value string")
    kinds = {r.line_id: r.kind for r in S.parse_packet_lines(df).collect()}
    assert kinds == {1: "skip", 2: "skip", 3: "skip", 4: "ok", 5: "malformed", 6: "missing", 7: "malformed"}
    ok = S.read_packet_tsv(df).collect()
    assert len(ok) == 1 and ok[0].proto == 6 and ok[0].length == 60 and ok[0].flags == "-A--S-"
    assert ok[0].timestamp == dt.datetime(2024, 5, 1, 12, 0, 0, 1)
    rej = {r.line_id: (r.reason, r.n_fields) for r in S.rejected_lines(df).collect()}
    assert rej == {5: ("malformed", 7), 6: ("missing", 8), 7: ("malformed", 7)}


def test_conform_access_log_defaults(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00", "1.1.1.1", None, "GET", "/x", None, None, None),
                                ("2024-01-01T10:00:00.5", "1.1.1.1", "5555", "GET", "/static/a.css", "12", "ua", "r")],
                               ",".join(f"{c} string" for c in ("timestamp client_ip src_port method path "
                                                                 "http_body_length user_agent referer").split()))
    out = clean.conform_access_log(df).collect()
    assert (out[0].src_port, out[0].http_body_length, out[0].user_agent, out[0].referer) == ("N/A", 0, "", "")
    assert out[1].timestamp == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert clean.exclude_static(clean.conform_access_log(df)).count() == 1


def test_parse_timestamp_strict_mode_raises(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("nope",)], "t string")
    assert df.select(X.parse_timestamp("t").alias("p")).where("p is null").count() == 1
    with pytest.raises(Exception, match="unparseable timestamp"):
        df.select(X.parse_timestamp("t", on_bad="error")).collect()


def test_scalars(spark):
    df = spark.createDataFrame([(0x12, 3232235777, dt.datetime(2024, 1, 2, 3, 4, 5))],
                               "m int, ip long, ts timestamp")
    r = df.select(X.tcp_flags_string("m").alias("f"), X.ipv4_to_string("ip").alias("ip"),
                  X.format_packet_ts("ts").alias("t")).first()
    assert (r.f, r.ip, r.t) == ("-A--S-", "192.168.1.1", "2024-01-02 03:04:05.000000")


def test_normalize_and_destination(spark):
    df = spark.createDataFrame([(6, 1000, 80, 0x12, "10.0.0.2", 4, 5), (17, 1000, 53, 0x12, "10.0.0.2", 4, 5),
                                (1, 1000, 53, 0x12, "10.0.0.2", 4, 5), (6, 1, 80, 0, "10.0.0.2", 6, 5),
                                (6, 1, 80, 0, "10.0.0.2", 4, 4)],
                               "proto int, src_port int, dst_port int, mask int, dst_ip string, ver int, ihl int")
    n = clean.normalize_flow_fields(df.withColumn("flags", F.lit("")), flag_mask_col="mask",
                                    ip_version_col="ver", ihl_col="ihl").collect()
    assert [(r.proto, r.src_port, r.dst_port, r.flags) for r in n] == [
        (6, 1000, 80, "-A--S-"), (17, 1000, 53, "-"), (1, 0, 0, "-")]
    assert clean.filter_destination(df, "10.0.0.2", 80).count() == 3


def test_union_logs_by_name(spark):
    a = spark.createDataFrame([("1.1.1.1", 5)], "client_ip string, http_body_length int")
    b = spark.createDataFrame([(7, "2.2.2.2")], "pkt_len int, client_ip string")
    u = S.union_logs([a, b]).collect()
    assert [(r.client_ip, r.http_body_length, r.pkt_len) for r in u] == [("1.1.1.1", 5, None), ("2.2.2.2", None, 7)]


def test_require_columns(spark):
    with pytest.raises(ValueError):
        S.require_columns(spark.createDataFrame([(1,)], "a int"), ["timestamp"])


def test_jdbc_options():
    o = S.jdbc_options({"POSTGRES_HOST": "h", "POSTGRES_DB": "d"})
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["driver"] == "org.postgresql.Driver"
