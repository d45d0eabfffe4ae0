"""Property tests: the distributed forms equal the simple definitions."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from trafficscore.operators import ranks
from trafficscore.operators.ratelimit import rate_limit_batch

T0 = dt.datetime(2024, 1, 1)
T0_US = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def brute(rows, window_us, limit):
    state, out = {}, {}
    for key, rel, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        us = rel + T0_US
        ws, c = state.get(key, (0, 0))
        ws, c = (us, 1) if us - ws > window_us else (ws, c + 1)
        state[key] = (ws, c)
        out[rid] = (c, c > limit)
    return out


requests = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 600_000_000)),
                    min_size=1, max_size=120)


@SETTINGS
@given(reqs=requests, window_s=st.sampled_from([1, 10, 60, 300]), limit=st.integers(1, 6),
       mode=st.sampled_from(["plain", "split", "tiny_slices"]))
def test_limiter_equals_dictionary_fold(spark, reqs, window_s, limit, mode):
    rows = [(k, us, i) for i, (k, us) in enumerate(reqs)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), i) for k, us, i in rows],
                               "client_ip string, timestamp timestamp, rid long")
    kw = {"plain": dict(split_hot_clients=False), "split": dict(min_hot_rows=0),
          "tiny_slices": dict(hot_rows=7)}[mode]
    out = rate_limit_batch(df, tie_col="rid", window_seconds=window_s, limit=limit, **kw)
    got = {r.rid: (r.request_count, r.over_limit) for r in out.collect()}
    assert got == brute(rows, window_s * 1_000_000, limit)


values = st.lists(st.one_of(st.none(), st.integers(-5, 5), st.integers(-1000, 1000)), min_size=1, max_size=80)


@SETTINGS
@given(vals=values, buckets=st.integers(2, 6))
def test_histogram_rank_equals_window(spark, vals, buckets):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v long")
    want = {r.id: r.pr for r in ranks.percent_rank_column(df, "v", "pr", method="window").collect()}
    got = {r.id: r.pr for r in ranks.percent_rank_column(
        df, "v", "pr", n_buckets=buckets).collect()}
    assert got == pytest.approx(want)


coarse = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40).map(lambda s: s * 15_000_000)),
                  min_size=1, max_size=150)


@SETTINGS
@given(reqs=coarse, limit=st.integers(1, 4), slice_rows=st.sampled_from([3, 5, 11]))
def test_limiter_ties_and_window_edges(spark, reqs, limit, slice_rows):
    """Timestamps on a 15 s grid with a 60 s window: many equal times,
    requests exactly one window apart, slice boundaries on window edges."""
    rows = [(k, us, i) for i, (k, us) in enumerate(reqs)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), i) for k, us, i in rows],
                               "client_ip string, timestamp timestamp, rid long")
    out = rate_limit_batch(df, tie_col="rid", window_seconds=60, limit=limit, hot_rows=slice_rows)
    got = {r.rid: (r.request_count, r.over_limit) for r in out.collect()}
    assert got == brute(rows, 60_000_000, limit)


# ---- packet-line classification vs. the line-by-line rules ------------------

def classify_line(line: str) -> str:
    s = line.strip(" \t\n\r\x0b\x0c")
    if not s or s.startswith("#") or s.startswith("Timestamp"):
        return "skip"
    parts = s.split("\t")
    if len(parts) != 8:
        return "malformed"
    if not parts[0] or not parts[1] or not parts[6]:
        return "missing"
    return "ok"


field = st.sampled_from(["", "x", "10.0.0.1", "2024-01-01 00:00:00.000001", "60", "#", "Timestamp", " a "])
lines = st.one_of(
    st.lists(field, min_size=1, max_size=10).map("\t".join),
    st.tuples(st.sampled_from(["", " ", "\t", "  \t"]), st.lists(field, min_size=1, max_size=9).map("\t".join),
              st.sampled_from(["", " ", "\t", "\n", " \t "])).map("".join),
)


@SETTINGS
@given(ls=st.lists(lines, min_size=1, max_size=40))
def test_packet_line_kinds_match_rules(spark, ls):
    from trafficscore.sources.logs import parse_packet_lines
    df = spark.createDataFrame(list(enumerate(ls)), "id int, value string")
    got = {r.id: r.kind for r in parse_packet_lines(df).collect()}
    assert got == {i: classify_line(x) for i, x in enumerate(ls)}


# ---- threshold rules vs. their plain statement ---------------------------------

def classify_py(r, f, m):
    lt = lambda a, b: a is not None and a == a and a < b      # noqa: E731  (NULL/NaN fail every test)
    gt = lambda a, b: a is not None and a == a and a > b      # noqa: E731
    le = lambda a, b: a is not None and a == a and a <= b     # noqa: E731
    if lt(r, 1 / 1440) and gt(f, 100):
        return "flood" if lt(m, 100) else "amp" if gt(m, 1200) else "susp"
    return "legit" if le(f, 100) else "unc"


def verdict_py(r, f, m):
    lt = lambda a, b: a is not None and a == a and a < b      # noqa: E731
    gt = lambda a, b: a is not None and a == a and a > b      # noqa: E731
    le = lambda a, b: a is not None and a == a and a <= b     # noqa: E731
    if lt(r, 1) and gt(f, 50):
        return lt(m, 100) or gt(m, 1200)
    if le(f, 50):
        return False
    return True


num = st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, 1 / 1440, 1.0, 50.0, 100.0, 1200.0, -1.0]),
                st.floats(-10, 2000, allow_nan=False))


@SETTINGS
@given(rows=st.lists(st.tuples(num, num, num), min_size=1, max_size=40))
def test_rules_match_plain_statement(spark, rows):
    from trafficscore.operators import rules
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, recency_days double, frequency double, monetary double")
    names = {rules.LABEL_FLOOD: "flood", rules.LABEL_AMPLIFICATION: "amp", rules.LABEL_SUSPICIOUS: "susp",
             rules.LABEL_LEGITIMATE: "legit", rules.LABEL_UNCERTAIN: "unc"}
    got = {r.id: (names[r.label], r.suspicious)
           for r in rules.suspicion_verdict(rules.classify_clients(df)).collect()}
    assert got == {i: (classify_py(*r), verdict_py(*r)) for i, r in enumerate(rows)}


# ---- the whole decision against a plain Python pipeline ------------------------

def decide_py(requests, table_rows, window_us, limit):
    """requests: (rid, ip, us, path); table_rows: (ip, r, freq, m)."""
    import pandas as pd
    t = pd.DataFrame(table_rows, columns=["ip", "r", "f", "m"])
    if len(t):
        t["f"] = t["f"].rank(method="average", pct=True) * 100
    state, out = {}, {}
    for rid, ip, rel, path in sorted(requests, key=lambda q: (q[2], q[0])):
        if path != "/sensitive-data":
            continue
        us = rel + T0_US                       # epoch micros, as the fold sees them
        ws, c = state.get(ip, (0, 0))
        ws, c = (us, 1) if us - ws > window_us else (ws, c + 1)
        state[ip] = (ws, c)
        if c <= limit or not ip:
            out[rid] = "allow"
            continue
        if ip == "127.0.0.1":
            out[rid] = "challenge"
            continue
        rows = t[t["ip"] == ip]
        r, f, m = (rows.iloc[0]["r"], rows.iloc[0]["f"], rows.iloc[0]["m"]) if len(rows) == 1 else (-1, -1, -1)
        if r < 1 and f > 50:
            s = m < 100 or m > 1200
        elif f <= 50:
            s = False
        else:
            s = True
        out[rid] = "challenge" if s else "allow"
    return out


ips = st.sampled_from(["1.1.1.1", "2.2.2.2", "3.3.3.3", "127.0.0.1", ""])


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(reqs=st.lists(st.tuples(ips, st.integers(0, 30).map(lambda s: s * 1_000_000),
                               st.sampled_from(["/sensitive-data", "/", "/static/x"])), min_size=1, max_size=80),
       table=st.lists(st.tuples(st.sampled_from(["1.1.1.1", "2.2.2.2", "9.9.9.9"]), st.sampled_from([0.5, 1.0, 2.0]),
                                st.integers(1, 100), st.sampled_from([0.0, 99.0, 100.0, 1200.0, 1201.0])),
                      min_size=1, max_size=8),
       limit=st.integers(1, 4))
def test_decision_matches_plain_pipeline(spark, reqs, table, limit):
    from trafficscore.operators import rules
    requests = [(i, ip, us, path) for i, (ip, us, path) in enumerate(reqs)]
    log = spark.createDataFrame([(i, ip, T0 + dt.timedelta(microseconds=us), path) for i, ip, us, path in requests],
                                "request_id long, client_ip string, timestamp timestamp, path string")
    rfm = spark.createDataFrame([(ip, float(r), f, float(m)) for ip, r, f, m in table],
                                "client_ip string, recency_days double, frequency long, monetary double")
    out = rules.decide_requests(log, rules.build_lookup_table(rfm), tie_col="request_id", window_seconds=10,
                                limit=limit)
    got = {r.request_id: r.decision for r in out.collect()}
    assert got == decide_py(requests, table, 10_000_000, limit)


# ---- size-checked join = plain join -------------------------------------------------

@SETTINGS
@given(big=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["hot", "a", "b", "c", "zz"])),
                              st.integers(0, 5)), min_size=1, max_size=150),
       hot_share=st.integers(0, 200), how=st.sampled_from(["left", "inner"]))
def test_size_checked_join_equals_plain_join(spark, big, hot_share, how):
    from trafficscore.plans.strategies import size_checked_join
    rows = [(i, k, v) for i, (k, v) in enumerate(big)] + [(1000 + j, "hot", j % 3) for j in range(hot_share)]
    left = spark.createDataFrame(rows, "id int, k string, v int")
    right = spark.createDataFrame([("hot", 1.5), ("a", 2.5), ("c", None), ("nope", 9.0)], "k string, w double")
    want = sorted(tuple(r) for r in left.join(right, "k", how).select("id", "k", "v", "w").collect())
    got = sorted(tuple(r) for r in size_checked_join(left, right, ["k"], how=how, broadcast_max_rows=0)
                 .select("id", "k", "v", "w").collect())
    assert got == want


# ---- average percentile and RFM vs. pandas ---------------------------------------

@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.integers(0, 6), st.integers(0, 500)), min_size=1, max_size=80),
       salted=st.booleans())
def test_average_percentile_equals_pandas(spark, vals, salted):
    import pandas as pd
    from trafficscore.operators.ranks import average_percentile
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v long")
    got = {r.id: r.p for r in average_percentile(df, "v", "p", n_buckets=7 if salted else 3).collect()}
    want = pd.Series(vals, dtype="float64").rank(method="average", pct=True) * 100
    for i, w in enumerate(want):
        assert (got[i] is None) if pd.isna(w) else got[i] == pytest.approx(w)


@SETTINGS
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
                               st.one_of(st.none(), st.integers(0, 10_000)),
                               st.one_of(st.none(), st.integers(0, 50))), min_size=1, max_size=60))
def test_compute_rfm_equals_pandas(spark, rows):
    import pandas as pd
    from trafficscore.operators.rfm import compute_rfm
    now = dt.datetime(2024, 2, 1)
    data = [(k, None if s is None else T0 + dt.timedelta(seconds=s), None if m is None else float(m))
            for k, s, m in rows]
    df = spark.createDataFrame(data, "client_ip string, timestamp timestamp, http_body_length double")
    got = {r.client_ip: (r.recency_days, r.frequency, r.monetary) for r in compute_rfm(df, now).collect()}
    pdf = pd.DataFrame(data, columns=["client_ip", "timestamp", "http_body_length"])
    pdf["timestamp"] = pd.to_datetime(pdf["timestamp"])
    g = pdf.groupby("client_ip")                     # NULL keys dropped, as pandas does
    rec = (pd.Timestamp(now) - g["timestamp"].max()).dt.total_seconds() / 86_400
    freq, mon = g["timestamp"].count(), g["http_body_length"].sum()
    assert set(got) == set(freq.index)
    for k in got:
        r, f, m = got[k]
        assert f == freq[k] and m == pytest.approx(mon[k])
        assert (r is None and pd.isna(rec[k])) or r == pytest.approx(rec[k])


# ---- scalar functions vs. Python ---------------------------------------------------

@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 255), st.integers(0, 2**32 - 1), st.floats(0, 1)), min_size=1,
                     max_size=50))
def test_scalars_equal_python(spark, vals):
    import ipaddress
    import math
    from trafficscore.functions import scalars as X
    df = spark.createDataFrame(list(enumerate(vals)), "id int, t struct<m:int, ip:long, r:double>").select(
        "id", "t.*")
    out = df.select("id", X.tcp_flags_string("m").alias("f"), X.ipv4_to_string("ip").alias("s"),
                    X.score_column("r", True).alias("hi"), X.score_column("r", False).alias("lo")).collect()
    for row in out:
        m, ip, r = vals[row.id]
        assert row.f == "".join(c if m & b else "-" for c, b in X.TCP_FLAG_BITS)
        assert row.s == str(ipaddress.IPv4Address(ip))
        assert row.hi == min(5, math.ceil(r * 5.0)) and row.lo == min(5, math.ceil((1.0 - r) * 5.0))


@SETTINGS
@given(items=st.lists(st.tuples(st.datetimes(min_value=dt.datetime(2000, 1, 1), max_value=dt.datetime(2030, 1, 1)),
                                st.sampled_from(["iso_us", "iso_s", "space_s", "space_us", "junk"])),
                      min_size=1, max_size=40))
def test_parse_timestamp_formats(spark, items):
    from trafficscore.functions.scalars import parse_timestamp
    texts, want = [], []
    for d, kind in items:
        if kind == "junk":
            texts.append("not a time " + d.isoformat()[:4])
            want.append(None)
            continue
        fmt = {"iso_us": "%Y-%m-%dT%H:%M:%S.%f", "iso_s": "%Y-%m-%dT%H:%M:%S", "space_s": "%Y-%m-%d %H:%M:%S",
               "space_us": "%Y-%m-%d %H:%M:%S.%f"}[kind]
        texts.append(d.strftime(fmt))
        want.append(d if kind.endswith("_us") else d.replace(microsecond=0))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.p for r in df.select("id", parse_timestamp("t").cast("timestamp_ntz").alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == want
