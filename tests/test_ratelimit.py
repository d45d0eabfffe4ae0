import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficscore.operators.ratelimit import fold_run, rate_limit_batch
from conftest import SF001, SF01

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


T0_US = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def brute(rows, window_us, limit):
    """Arrival-order dictionary limiter (the per-request semantics) on epoch
    micros; returned window starts are relative to T0 again."""
    state, out = {}, {}
    for key, rel, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        us = rel + T0_US
        ws, c = state.get(key, (0, 0))
        if us - ws > window_us:
            ws, c = us, 1
        else:
            c += 1
        state[key] = (ws, c)
        out[rid] = (ws - T0_US, c, c > limit)
    return out


def _run(spark, rows, window_s=60, limit=10, **kw):
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), rid) for k, us, rid in rows],
                               "client_ip string, timestamp timestamp, rid long")
    out = rate_limit_batch(df, tie_col="rid", window_seconds=window_s, limit=limit, **kw)
    return {r.rid: r for r in out.collect()}


def test_eleven_in_one_second(spark):
    rows = [("a", i * 50_000, i) for i in range(11)]
    got = _run(spark, rows)
    assert [got[i].request_count for i in range(11)] == list(range(1, 12))
    assert [got[i].over_limit for i in range(11)] == [False] * 10 + [True]


def test_window_edges(spark):
    s = 1_000_000
    rows = [("a", 0, 0), ("a", 60 * s, 1), ("a", 60 * s + 1, 2), ("b", 0, 3), ("b", 60 * s + 1, 4)]
    got = _run(spark, rows)
    assert got[1].request_count == 2            # exactly 60 s after the start: same window
    assert got[2].request_count == 1            # 60 s + 1 us after the start: new window
    assert got[4].request_count == 1 and got[3].request_count == 1


def test_new_window_after_expiry_exact(spark):
    s = 1_000_000
    rows = [("a", 0, 0), ("a", 60 * s + 1, 1)]
    got = _run(spark, rows)
    assert got[1].request_count == 1 and got[1].window_start == T0 + dt.timedelta(microseconds=60 * s + 1)


@pytest.mark.parametrize("kw", [dict(split_hot_clients=False), dict(split_hot_clients=True),
                                dict(split_hot_clients=True, min_hot_rows=0),
                                dict(split_hot_clients=True, hot_rows=50)])
def test_matches_brute_force(spark, kw):
    rnd = random.Random(3)
    rows, rid = [], 0
    for key, n, gap in (("hot", 3000, 2_000_000), ("b", 200, 20_000_000), ("c", 50, 90_000_000),
                        ("d", 400, 500_000)):
        us = rnd.randrange(0, 10_000_000)
        for _ in range(n):
            us += rnd.randrange(0, 2 * gap)
            rows.append((key, us, rid))
            rid += 1
    # equal timestamps are ordered by the tie column
    rows.append(("b", rows[3100][1], rid))
    want = brute(rows, 60_000_000, 10)
    got = _run(spark, rows, **kw)
    for r, (ws, c, over) in want.items():
        g = got[r]
        assert (g.request_count, g.over_limit) == (c, over), r
        assert g.window_start == T0 + dt.timedelta(microseconds=ws)


def test_state_carried_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a", i * 1_000_000, i) for i in range(100)] + [("b", i * 5_000_000, 1000 + i) for i in range(40)]
        want = brute(rows, 60_000_000, 10)
        got = _run(spark, rows)
        assert {k: (v.request_count, v.over_limit) for k, v in got.items()} == {k: (c, o) for k, (_, c, o) in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fold_run_units():
    import numpy as np
    ts = np.array([0, 10, 61, 200], dtype=np.int64)
    ws, cnt, last_ws, last_cnt = fold_run(ts, 0, 0, 60)
    # starting state (0, 0): ts 0 is not > 60 after start 0, so it continues window 0
    assert list(cnt) == [1, 2, 1, 1] and list(ws) == [0, 0, 61, 200]
    assert (last_ws, last_cnt) == (200, 1)


@pytest.mark.parametrize("sf,expected", [(SF001, (218, 1000)), (SF01, (2115, 10000))])
def test_fixture_counts(spark, sf, expected):
    from trafficscore.plans import views as V
    out = rate_limit_batch(V.access_log(spark, sf), tie_col="request_id", window_seconds=86_400, limit=3)
    agg = out.agg(F.sum(F.col("over_limit").cast("int")).alias("o"), F.count("*").alias("n")).first()
    assert (agg.o, agg.n) == expected


def test_dense_hot_client(spark):
    """Evenly spaced requests: the window phase of a slice that started fresh
    would never re-align with the true one, so every slice boundary must get
    its exact incoming window start (transfer tables + pointer doubling)."""
    rows = [("flood", i * 7_000_000, i) for i in range(1200)] + [("x", i * 61_000_000, 5000 + i) for i in range(30)]
    want = brute(rows, 60_000_000, 5)
    got = _run(spark, rows, limit=5, hot_rows=150)
    assert {k: (v.request_count, v.over_limit) for k, v in got.items()} == \
        {k: (c, o) for k, (_, c, o) in want.items()}


def test_nullable_numeric_keys_keep_every_digit(spark):
    """Keys above 2**53 that differ by one, NULL keys, and a passed-through long."""
    big = 2**53
    rows = [(None, 0, 1), (None, 5, 2), (big, 0, 3), (big + 1, 1, 4), (big, 30, 5), (None, 70, 6), (None, 140, 7)]
    for kw in ({}, {"hot_rows": 1}, {"hot_rows": 0}, {"split_hot_clients": False}):
        df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i, big + 1) for k, s, i in rows],
                                   "user_id bigint, timestamp timestamp, rid long, extra bigint")
        out = rate_limit_batch(df, key_col="user_id", tie_col="rid", window_seconds=60, limit=1, **kw)
        got = {r.rid: (r.user_id, r.request_count, r.extra) for r in out.collect()}
        assert got == {1: (None, 1, big + 1), 2: (None, 2, big + 1), 3: (big, 1, big + 1), 4: (big + 1, 1, big + 1),
                       5: (big, 2, big + 1), 6: (None, 1, big + 1), 7: (None, 1, big + 1)}, kw


def test_far_future_and_past_clocks(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('a', timestamp'9999-12-31 23:59:59', 1L), ('a', timestamp'2024-01-01', 2L),
                        ('a', timestamp'0001-01-01', 3L) AS t(client_ip, timestamp, rid)""")
    for kw in ({}, {"hot_rows": 1}):
        out = rate_limit_batch(rows, tie_col="rid", **kw).select("rid", "request_count")
        assert {(r.rid, r.request_count) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_idle_client_then_a_flood(spark):
    year = 365 * 86_400 * 1_000_000
    rows = [("bot", 0, 0)] + [("bot", year + 7_000 * i, 1 + i) for i in range(4000)]
    want = brute(rows, 1_000_000, 10)
    for kw in ({}, {"hot_rows": 100}):
        got = _run(spark, rows, window_s=1, **kw)
        assert {k: (v.request_count, v.over_limit) for k, v in got.items()} == {k: (c, o) for k, (_, c, o) in want.items()}


def test_only_keys_and_times_reach_python(spark):
    df = spark.createDataFrame([("a", T0, 1, "agent")], "client_ip string, timestamp timestamp, rid long, user_agent string")
    plan = rate_limit_batch(df, tie_col="rid")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("MapInArrow")
    assert "user_agent" not in plan[at:plan.index("\n", at)] and "rid" not in plan[at:plan.index("\n", at)]


def test_equal_times_without_tie_column_are_deterministic(spark):
    same = T0 + dt.timedelta(seconds=5)
    df = spark.createDataFrame([("a", same, f"r{i}") for i in range(12)], "client_ip string, timestamp timestamp, x string")
    runs = []
    for parts in (1, 3, 8):
        out = rate_limit_batch(df.repartition(parts), limit=10)
        assert out.columns == ["client_ip", "timestamp", "x", "request_count", "over_limit", "window_start"]
        runs.append(sorted((r.x, r.request_count) for r in out.collect()))
    assert runs[0] == runs[1] == runs[2]
    assert sorted(c for _, c in runs[0]) == list(range(1, 13))


def test_null_client_key_with_hot_split(spark):
    """Requests without a client key form one group (like a dictionary key
    None); a hot NULL group is split like any other."""
    rows = [(None, i * 3_000_000, i) for i in range(60)] + [("a", i * 2_000_000, 100 + i) for i in range(80)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), rid) for k, us, rid in rows],
                               "client_ip string, timestamp timestamp, rid long")
    out = rate_limit_batch(df, tie_col="rid", window_seconds=60, limit=10, hot_rows=20)
    got = {r.rid: (r.request_count, r.over_limit) for r in out.collect()}
    want = brute(rows, 60_000_000, 10)
    assert got == {k: (c, o) for k, (_, c, o) in want.items()}


def test_numeric_client_key_with_hot_split(spark):
    rows = [(7, i * 1_000_000, i) for i in range(150)] + [(8, i * 40_000_000, 500 + i) for i in range(20)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), rid) for k, us, rid in rows],
                               "user_id bigint, timestamp timestamp, rid long")
    out = rate_limit_batch(df, key_col="user_id", tie_col="rid", window_seconds=60, limit=10, hot_rows=25)
    got = {r.rid: (r.request_count, r.over_limit) for r in out.collect()}
    assert got == {k: (c, o) for k, (_, c, o) in brute(rows, 60_000_000, 10).items()}


def test_transfer_function_equals_the_fold():
    """For every incoming start, a slice's step gives the last window start in it and that window's rows."""
    import bisect
    import numpy as np
    from trafficscore.operators.ratelimit import _NEVER, transfer
    rnd = random.Random(11)
    for _ in range(200):
        window = rnd.randint(1, 30)
        times = sorted(rnd.sample(range(100, 300), rnd.randint(1, 60)))
        counts = [rnd.randint(1, 3) for _ in times]
        low, exits, tail = (x.tolist() for x in transfer(np.array(times), np.array(counts), window))
        assert low[0] == _NEVER and low == sorted(set(low))
        for s in [_NEVER, *range(times[0] - window - 3, times[0])]:
            ws = s
            for t in times:
                if t - ws > window:
                    ws = t
            k = bisect.bisect_right(low, s) - 1
            if ws == s:
                assert (exits[k], tail[k]) == (_NEVER, 0)
            else:
                assert (exits[k], tail[k]) == (ws, sum(c for t, c in zip(times, counts) if t >= ws))


def test_hot_client_is_dealt_to_slices(spark):
    """A client with most rows: no (client, slice) holds much over the threshold, and the result is the fold's."""
    from trafficscore.operators.ratelimit import slice_sizes
    rows = [("hot", i * 900_000 + i % 7, i) for i in range(4000)] + [("b", i * 30_000_000, 9000 + i) for i in range(300)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=us), rid) for k, us, rid in rows],
                               "client_ip string, timestamp timestamp, rid long")
    sizes = {(r.client_ip, r.slice): r["rows"] for r in slice_sizes(df, hot_rows=400).collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) >= 9 and max(hot) <= 600 and sum(hot) == 4000 and sizes["b", 0] == 300
    want = brute(rows, 60_000_000, 10)
    got = _run(spark, rows, hot_rows=400)
    assert {k: (v.request_count, v.over_limit) for k, v in got.items()} == {k: (c, o) for k, (_, c, o) in want.items()}
