"""Plan-shape checks: pushdown, pruning, partial aggregation, broadcast
bounds and no unpartitioned window on the distributed rank path."""

import os


from trafficscore.operators import clean, rfm, rules
from trafficscore.plans import views as V
from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _landed_access_log(spark, scratch):
    path = os.path.join(scratch, "access.parquet")
    V.access_log(spark, SF001).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(spark, scratch):
    log = _landed_access_log(spark, scratch)
    q = clean.exclude_static(clean.filter_since(log, "2024-01-15 00:00:00")).select("client_ip")
    plan = _plan(q)
    assert "PushedFilters: [" in plan
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThan(timestamp" in pushed and "Or(IsNull(path),Not(StringSt" in pushed
    schema = plan.split("ReadSchema: ", 1)[1].split("\n", 1)[0]
    assert "http_body_length" not in schema and "user_agent" not in schema      # column pruning
    p = clean.protected_requests(log)
    assert "In(path" in _plan(p).split("PushedFilters: [", 1)[1].split("]", 1)[0]


def test_rfm_is_one_shuffle_with_partial_aggregation(spark, scratch):
    log = _landed_access_log(spark, scratch)
    plan = _plan(rfm.compute_rfm(log, V.EVENTS_NOW))
    assert plan.count("Exchange hashpartitioning(client_ip") == 1
    assert "partial_max" in plan and "partial_count" in plan and "partial_sum" in plan


def test_lookup_join_broadcasts_only_counted_side(spark, scratch):
    log = _landed_access_log(spark, scratch)
    table = rules.build_lookup_table(rfm.compute_rfm(log, V.EVENTS_NOW))
    small = _plan(rules.lookup_rfm(log, table))
    assert "BroadcastHashJoin" in small
    # beyond the bound: shuffle join (Spark's own size-based broadcast
    # switched off to see the shuffle form)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = _plan(rules.lookup_rfm(log, table, broadcast_max_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in big and "_spread" in big


def test_distributed_rank_has_no_global_window_on_rows(spark, scratch):
    from trafficscore.operators.ranks import percent_rank_column
    log = _landed_access_log(spark, scratch)
    r = rfm.compute_rfm(log, V.EVENTS_NOW)
    plan = _plan(percent_rank_column(r, "monetary", "pr", method="histogram", n_buckets=4))
    # the only unpartitioned window is over the bucket totals 
    assert "hashpartitioning(_c" in plan
    assert "percent_rank" not in plan


def test_landed_logs_prune_days(spark, scratch):
    from trafficscore.sources.sinks import land_logs
    path = os.path.join(scratch, "landed")
    land_logs(V.access_log(spark, SF001), path)
    log = spark.read.parquet(path)
    q = clean.filter_since(log, "2024-01-25 12:00:00", partition_col="date")
    plan = _plan(q)
    assert "PartitionFilters: [isnotnull(date" in plan and "(date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    want = clean.filter_since(V.access_log(spark, SF001), "2024-01-25 12:00:00").count()
    assert q.count() == want > 0


def test_score_rfm_has_no_single_partition_exchange(spark):
    """No plan of the scored table gathers rows in one task."""
    from trafficscore.operators.score import score_rfm
    raw = spark.range(3000).selectExpr("cast(id as string) as src_ip", "id % 700 as recency_raw", "id % 11 as frequency_raw",
                                       "id * 3 as monetary_raw")
    assert "SinglePartition" not in _plan(score_rfm(raw, "t"))


def test_rows_without_key_are_dealt_evenly(spark):
    """95% of the requests have no key: with AQE off, no partition of the join
    holds over twice the mean."""
    from pyspark.sql import functions as F
    from trafficscore.plans.strategies import size_checked_join
    big = spark.range(40_000).select("id", F.when(F.col("id") % 20 == 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    small = spark.range(0, 40_000, 40).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit(1).alias("w"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = size_checked_join(big, small, "k", broadcast_max_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert out.count() == 40_000 and out.where("w = 1").count() == 1000
        assert max(sizes) <= 2 * 40_000 / len(sizes) and len(sizes) == 8
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
