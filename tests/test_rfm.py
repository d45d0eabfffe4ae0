import datetime as dt

from pyspark.sql import functions as F

from trafficscore.operators import rfm, rules
from trafficscore.plans import views as V
from conftest import SF01


def test_nulls_and_missing_monetary(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 5.0), ("a", None, None), ("b", None, 3.0), (None, t, 1.0),
                                ("c", t, None)], "client_ip string, timestamp timestamp, http_body_length double")
    got = {r.client_ip: r for r in rfm.compute_rfm(df, dt.datetime(2024, 1, 2)).collect()}
    assert set(got) == {"a", "b", "c"}                           # NULL key dropped
    assert (got["a"].recency_days, got["a"].frequency, got["a"].monetary) == (1.0, 1, 5.0)
    assert got["b"].recency_days is None and got["b"].frequency == 0
    assert got["c"].monetary == 0                                 # all-NULL sum -> 0
    assert rfm.compute_rfm(df.drop("http_body_length"), dt.datetime(2024, 1, 2)).columns == \
        ["client_ip", "recency_days", "frequency"]


def test_fixture_counts_sf01(spark):
    # the documented counts are over every event (static rows included)
    acc = V.access_log(spark, SF01)
    r = rfm.compute_rfm(acc, V.EVENTS_NOW)
    lab = {x.label: x.n for x in rules.classify_clients(r, low_recency=0.3, high_frequency=66, low_monetary=3200,
                                                      high_monetary=3800)
           .groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert lab == {rules.LABEL_FLOOD: 7, rules.LABEL_AMPLIFICATION: 16, rules.LABEL_SUSPICIOUS: 18,
                   rules.LABEL_LEGITIMATE: 75, rules.LABEL_UNCERTAIN: 34}
    t = rules.build_lookup_table(r)
    v = rules.suspicion_verdict(t, max_recency_days=1, freq_pct=50, low_monetary=1800, high_monetary=3000)
    cases = v.select(
        F.when((F.col("recency_days") < 1) & (F.col("frequency") > 50), F.concat(F.lit("a"), F.col("suspicious").cast("string")))
        .when(F.col("frequency") <= 50, F.lit("f_low")).otherwise(F.lit("old")).alias("c"))
    got = {x.c: x.n for x in cases.groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"atrue": 64, "afalse": 5, "f_low": 75, "old": 6}


def test_packet_raw_seconds(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 900000)
    df = spark.createDataFrame([("x", t, 10), ("x", t - dt.timedelta(days=1), 5)],
                               "src_ip string, timestamp timestamp, pkt_len long")
    r = rfm.rfm_raw_packets(df, dt.datetime(2024, 1, 1, 0, 1, 0)).first()
    assert (r.frequency_raw, r.monetary_raw, r.recency_raw) == (2, 15, 60)


def test_traffic_totals(spark):
    df = spark.createDataFrame([("a", 10), ("a", 5), ("b", None)], "src_ip string, length long")
    assert rfm.traffic_totals(df).first().asDict() == {"packets": 3, "bytes": 15}
    got = {r.src_ip: (r.packets, r.bytes) for r in rfm.traffic_totals(df, "src_ip").collect()}
    assert got == {"a": (2, 15), "b": (1, 0)}
