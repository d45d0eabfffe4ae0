import pytest

from trafficscore.operators import rules

CLASSIFY_CASES = [
    # the six documented cases
    (0.275, 11, 0, "Legitimate User"),
    (0.000510, 32861, 0, "DDoS - Flood Attack"),
    (0.000315, 5000, 1500, "DDoS - Amplification Attack"),
    (0.000682, 200, 300, "Suspicious - Needs Monitoring"),
    (0.0456, 95, 200, "Legitimate User"),
    (0.0023, 101, 800, "Uncertain - Possibly Legit or Slow-Rate Attack"),
    # strict boundaries
    (1 / 1440, 101, 0, "Uncertain - Possibly Legit or Slow-Rate Attack"),
    (0.0001, 100, 0, "Legitimate User"),
    (0.0001, 101, 100, "Suspicious - Needs Monitoring"),
    (0.0001, 101, 1200, "Suspicious - Needs Monitoring"),
]


def test_classify_cases(spark):
    df = spark.createDataFrame([(i, r, f, float(m)) for i, (r, f, m, _) in enumerate(CLASSIFY_CASES)],
                               "id int, recency_days double, frequency long, monetary double")
    got = {r.id: r.label for r in rules.classify_clients(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(CLASSIFY_CASES)}


def test_classify_missing_values_fail_their_tests(spark):
    df = spark.createDataFrame([(None, 500, 50.0), (0.0001, None, 50.0), (float("nan"), 500, 50.0),
                                (0.0001, 500, None)],
                               "recency_days double, frequency long, monetary double")
    got = [r.label for r in rules.classify_clients(df).collect()]
    # NULL/NaN recency: not recent -> frequency decides; NULL frequency -> uncertain;
    # NULL monetary in the recent+frequent branch -> neither low nor high
    assert got == ["Uncertain - Possibly Legit or Slow-Rate Attack",
                   "Uncertain - Possibly Legit or Slow-Rate Attack",
                   "Uncertain - Possibly Legit or Slow-Rate Attack",
                   "Suspicious - Needs Monitoring"]


VERDICT_CASES = [
    (-1, -1, -1, False),      # unknown ip, compat
    (0.5, 50, 0, False),
    (0.5, 50.1, 99, True),
    (0.5, 50.1, 100, False),
    (0.5, 50.1, 1200, False),
    (0.5, 50.1, 1201, True),
    (1.0, 50.1, 500, True),
    (1.0, 50, 500, False),
]


def test_verdict_cases(spark):
    df = spark.createDataFrame([(i, float(r), float(f), float(m)) for i, (r, f, m, _) in enumerate(VERDICT_CASES)],
                               "id int, recency_days double, frequency double, monetary double")
    got = {r.id: r.suspicious for r in rules.suspicion_verdict(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(VERDICT_CASES)}


def test_verdict_unknown_policy(spark):
    df = spark.createDataFrame([(-1.0, -1.0, -1.0)], "recency_days double, frequency double, monetary double")
    assert rules.suspicion_verdict(df, unknown_policy="suspicious").first().suspicious is True
    with pytest.raises(ValueError):
        rules.suspicion_verdict(df, unknown_policy="other")


def test_lookup_sentinel_and_duplicate_guard(spark):
    rfm = spark.createDataFrame([("1.1.1.1", 0.5, 10, 5.0), ("2.2.2.2", 0.1, 20, 7.0), ("2.2.2.2", 0.2, 30, 9.0),
                                 ("3.3.3.3", 3.0, 40, 1.0)],
                                "client_ip string, recency_days double, frequency long, monetary double")
    table = rules.build_lookup_table(rfm)
    req = spark.createDataFrame([(1, "1.1.1.1"), (2, "2.2.2.2"), (3, "9.9.9.9")], "rid int, client_ip string")
    got = {r.rid: (r.recency_days, r.frequency, r.monetary) for r in rules.lookup_rfm(req, table).collect()}
    # frequency percentile is over the whole table (4 rows): 10 -> 25 %
    assert got[1] == (0.5, 25.0, 5.0)
    assert got[2] == (-1.0, -1.0, -1.0)     # duplicated key -> unknown
    assert got[3] == (-1.0, -1.0, -1.0)     # absent key -> unknown


def test_single_row_table_is_frequent(spark):
    rfm = spark.createDataFrame([("172.30.0.1", 0.09269420357638888, 11, 0.0)],
                                "client_ip string, recency_days double, frequency long, monetary double")
    t = rules.build_lookup_table(rfm)
    row = t.first()
    assert row.frequency == 100.0
    assert rules.suspicion_verdict(t).first().suspicious is True  # recent, f=100 > 50, m=0 < 100


def test_decide_requests_loopback_and_no_monetary(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), "127.0.0.1", "/sensitive-data") for i in range(12)]
    rows += [(100 + i, t0 + dt.timedelta(seconds=i), "5.5.5.5", "/sensitive-data") for i in range(12)]
    rows += [(200, t0, "5.5.5.5", "/")]
    log = spark.createDataFrame(rows, "request_id long, timestamp timestamp, client_ip string, path string")
    table = spark.createDataFrame([("5.5.5.5", 0.5, 60.0, 5.0)],
                                  "client_ip string, recency_days double, frequency double, monetary double")
    out = {r.request_id: r for r in rules.decide_requests(log, table, tie_col="request_id").collect()}
    assert len(out) == 24                        # only the protected route
    assert out[10].decision == "challenge" and out[11].decision == "challenge"   # loopback over limit
    assert out[9].decision == "allow"            # count 10 is not over 10
    assert out[110].decision == "challenge"      # recent, frequent, monetary 5 < 100
    no_m = table.drop("monetary")
    out2 = {r.request_id: r for r in rules.decide_requests(log, no_m, tie_col="request_id").collect()}
    assert out2[110].decision == "allow"         # lookup cannot produce m -> allow
    assert out2[11].decision == "challenge"      # loopback override still applies


def test_verified_clients_and_empty_ip(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), ip, "/sensitive-data") for ip in ("6.6.6.6", "7.7.7.7", "")
            for i in range(12)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    log = spark.createDataFrame(rows, "request_id long, timestamp timestamp, client_ip string, path string")
    verified = spark.createDataFrame([("7.7.7.7",)], "client_ip string")
    table = spark.createDataFrame([("6.6.6.6", 0.5, 60.0, 5.0), ("", 0.5, 60.0, 5.0)],
                                  "client_ip string, recency_days double, frequency double, monetary double")
    out = rules.decide_requests(log, table, tie_col="request_id", verified=verified,
                                unknown_policy="suspicious").collect()
    assert {r.client_ip for r in out} == {"6.6.6.6", ""}          # verified client bypasses the check
    by_ip = {}
    for r in out:
        by_ip.setdefault(r.client_ip, set()).add(r.decision)
    assert by_ip["6.6.6.6"] == {"allow", "challenge"} and by_ip[""] == {"allow"}


def test_check_scores_table(spark):
    from trafficscore.operators.score import check_scores_table
    df = spark.createDataFrame([("a", 1, 1, 1, 111.0, "t"), ("a", 2, 2, 2, 222.0, "t"), ("b", None, 1, 1, None, "t")],
                               "src_ip string, r_score int, f_score int, m_score int, composite_score float, "
                               "last_updated string")
    got = sorted((r.src_ip, r.reason) for r in check_scores_table(df).collect())
    assert got == [("a", "duplicate key"), ("b", "null value")]


def test_source_timezone(spark):
    import datetime as dt
    from trafficscore.operators.clean import clean_packets
    df = spark.createDataFrame([("2024-01-01 12:00:00", "1.1.1.1", "5")], "timestamp string, src_ip string, pkt_len string")
    r = clean_packets(df, source_tz="Europe/Berlin").first()
    assert r.timestamp == dt.datetime(2024, 1, 1, 11, 0, 0)


def test_point_lookup_and_verdict(spark):
    rfm = spark.createDataFrame([("1.1.1.1", 0.5, 10, 5.0), ("2.2.2.2", 0.1, 20, 7.0), ("2.2.2.2", 0.2, 30, 9.0)],
                                "client_ip string, recency_days double, frequency long, monetary double")
    assert rules.lookup_point(rfm, "1.1.1.1").first().asDict() == {"client_ip": "1.1.1.1", "recency_days": 0.5,
                                                                  "frequency": 10.0, "monetary": 5.0}
    assert rules.lookup_point(rfm, "2.2.2.2").first().recency_days == -1.0      # not exactly one row
    assert rules.lookup_point(rfm, "9.9.9.9").first().frequency == -1.0
    t = rules.build_lookup_table(rfm)
    assert rules.verdict_for(t, "1.1.1.1").first().suspicious is False          # f = 33.3 <= 50
    assert rules.verdict_for(t, "9.9.9.9").first().suspicious is False          # unknown, compat
    assert rules.verdict_for(t, "9.9.9.9", unknown_policy="suspicious").first().suspicious is True
    assert rules.verdict_for(t, "").first().suspicious is False
