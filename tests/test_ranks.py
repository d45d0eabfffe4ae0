import random
import re

import pytest

from trafficscore.operators import ranks, score

FREQS = [10, 20, 20, 20, 1, 2]


def _df(spark, values, col="v", typ="long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {col} {typ}")


@pytest.mark.parametrize("method,kw", [("window", {}), ("histogram", {}),
                                       ("histogram", dict(n_buckets=3)),
                                       ("histogram", dict(n_buckets=1))])
def test_tie_fixture(spark, method, kw):
    out = ranks.percent_rank_column(_df(spark, FREQS), "v", "pr", method=method, **kw)
    got = {r.id: round(r.pr, 9) for r in out.collect()}
    assert [got[i] for i in range(6)] == [0.4, 0.6, 0.6, 0.6, 0.0, 0.2]
    ap = ranks.average_percentile(_df(spark, FREQS), "v", "pct",
                                  method="window" if method == "window" else "histogram", **kw)
    got = {r.id: round(r.pct, 6) for r in ap.collect()}
    assert [got[i] for i in range(6)] == [50.0, 83.333333, 83.333333, 83.333333, 16.666667, 33.333333]


def test_scores_on_ties(spark):
    raw = spark.createDataFrame([(str(i), v, v, v) for i, v in enumerate(FREQS)],
                                "src_ip string, recency_raw long, frequency_raw long, monetary_raw long")
    got = {r.src_ip: r for r in score.score_rfm(raw, "t").collect()}
    assert [got[str(i)].f_score for i in range(6)] == [2, 3, 3, 3, 0, 1]
    assert [got[str(i)].r_score for i in range(6)] == [3, 2, 2, 2, 5, 4]
    clamped = {r.src_ip: r for r in score.score_rfm(raw, "t", min_score=1).collect()}
    assert clamped["4"].f_score == 1


def test_single_row(spark):
    raw = spark.createDataFrame([("a", 5, 7, 9)], "src_ip string, recency_raw long, frequency_raw long, monetary_raw long")
    for m in ("window", "histogram"):
        row = score.score_rfm(raw, "t", rank_method=m).first()
        assert (row.r_score, row.f_score, row.m_score, row.composite_score) == (5, 0, 0, 500.0)
    assert ranks.average_percentile(_df(spark, [3]), "v", "p").first().p == 100.0


def test_histogram_equals_window_random(spark):
    rnd = random.Random(7)
    # a hot value holding a third of the rows, NULLs, near-unique doubles
    vals = [0.0] * 300 + [None] * 40 + [round(rnd.uniform(0, 50), 1) for _ in range(560)]
    rnd.shuffle(vals)
    df = _df(spark, vals, typ="double")
    want = {r.id: r.pr for r in ranks.percent_rank_column(df, "v", "pr", method="window").collect()}
    for kw in ({}, dict(n_buckets=7), dict(n_buckets=200)):
        got = {r.id: r.pr for r in ranks.percent_rank_column(df, "v", "pr", method="histogram", **kw).collect()}
        assert got == pytest.approx(want)
    wa = {r.id: r.p for r in ranks.average_percentile(df, "v", "p", method="window").collect()}
    for kw in ({}, dict(n_buckets=5)):
        ga = {r.id: r.p for r in ranks.average_percentile(df, "v", "p", **kw).collect()}
        assert ga.keys() == wa.keys()
        for k in wa:
            assert (ga[k] is None and wa[k] is None) or ga[k] == pytest.approx(wa[k])


def test_pandas_average_rank_agrees(spark):
    import pandas as pd
    vals = [5, 3, 3, None, 8, 8, 8, 1]
    want = pd.Series(vals, dtype="float64").rank(method="average", pct=True) * 100
    got = {r.id: r.p for r in ranks.average_percentile(_df(spark, vals), "v", "p").collect()}
    for i, w in enumerate(want):
        if pd.isna(w):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(w)


def test_distributed_plan_has_no_single_partition_window(spark):
    df = _df(spark, list(range(1000)))
    out = ranks.percent_rank_column(df, "v", "pr", method="histogram", n_buckets=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the value-level prefix sum is partitioned by bucket; only the bucket
    # offsets (at most a few thousand rows) use an unpartitioned window
    assert "hashpartitioning(_c" in plan


def test_many_buckets_are_exact(spark):
    """Many buckets rank exactly."""
    from pyspark.sql import functions as F
    df = spark.range(60_000).select("id", F.pmod(F.col("id") * 7919, F.lit(40_009)).alias("v"))
    h = ranks.percent_rank_column(df, "v", "pr", method="histogram", n_buckets=256)
    w = ranks.percent_rank_column(df, "v", "pw", method="window").select("id", "pw")
    assert h.join(w, "id").where(F.abs(F.col("pr") - F.col("pw")) > 1e-12).count() == 0


@pytest.mark.parametrize("key", ["k", None])
def test_several_columns_with_repeated_keys_and_rows(spark, key):
    """Rows that share a key, rows that are equal throughout, NULL keys and values, longs beyond 2**53."""
    rnd = random.Random(5)
    rows = [(f"c{i}" if i % 11 else None, rnd.choice([None, 1, 1, 1, rnd.randint(0, 90)]),
             rnd.choice([0.0, -0.0, float("nan"), 1.5, rnd.random()]), 2**53 + rnd.randint(0, 3), "x" * (i % 3))
            for i in range(150)]
    rows += rows[:20] + [(f"c{i}", 1, 0.0, 2**53, str(j)) for i in (1, 2) for j in range(10)]
    df = spark.createDataFrame(rows, "k string, a long, b double, c long, payload string")
    specs = {"ra": "a", "rb": "b", "rc": "c", "ra2": "a"}
    want = sorted(repr(r).replace("-0.0", "0.0") for r in ranks.add_percent_ranks(df, specs, method="window").collect())
    for buckets in (None, 3, 40):
        got = ranks.add_percent_ranks(df, specs, n_buckets=buckets, key=key)
        assert got.columns == [*df.columns, *specs]
        assert sorted(repr(r).replace("-0.0", "0.0") for r in got.collect()) == want
    assert ranks.add_percent_ranks(df.limit(0), specs, key=key).collect() == []


def test_a_value_that_most_rows_share_is_dealt_evenly(spark):
    """90% of the rows have frequency 1: no rank partition holds over twice the mean of its column's rows."""
    from pyspark.sql import functions as F
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(1)).otherwise(F.col("id")).alias("v"))
    entries = ranks.Ranked(df, ["v"], [], 8).entries
    sizes = [r["count"] for r in entries.groupBy("_b", "_s").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / 8


def test_rank_plan_has_no_join_on_values(spark):
    raw = spark.range(3000).selectExpr("cast(id as string) as src_ip", "id % 700 as recency_raw", "id % 11 as frequency_raw",
                                       "id * 3 as monetary_raw")
    plan = score.score_rfm(raw, "t")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Join") == 1 and "BroadcastHashJoin [_c" in plan
    # the entries; the buckets' row counts and their running sums
    assert plan.count("Exchange hashpartitioning(_c") == 3 and len(re.findall(r"Exchange hashpartitioning\(_c#\d+, _b#\d+, _s#", plan)) == 1
