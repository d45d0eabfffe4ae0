"""The lookup table in buckets: no shuffle, point reads of one bucket, hot and absent clients."""

import os
import uuid

from pyspark.sql import functions as F

from trafficscore.operators import lookup, rules


def _save(df, scratch, n=8):
    name = f"t_{uuid.uuid4().hex}"
    return lookup.save_bucketed(df, name, os.path.join(scratch, name), n_buckets=n)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _table(spark):
    return spark.range(200).select(F.concat(F.lit("10.0.0."), F.col("id")).alias("client_ip"),
                                   F.col("id").cast("double").alias("recency_days"),
                                   (F.col("id") * 2).cast("double").alias("frequency"),
                                   F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("monetary"))


def _requests(spark, hot_share=0.0):
    i = F.col("id")
    ip = (F.when(i % 10 == 3, F.lit(None)).when(i < 3000 * hot_share, F.lit("10.0.0.7"))
          .otherwise(F.concat(F.lit("10.0.0."), i % 250)))
    return spark.range(3000).select(i.alias("request_id"), ip.alias("client_ip"))


def _rows(df):
    return sorted((r.request_id, r.client_ip, r.recency_days, r.frequency, r.monetary) for r in df.select(
        "request_id", F.coalesce("client_ip", F.lit("")).alias("client_ip"), "recency_days", "frequency",
        F.coalesce("monetary", F.lit(-7.0)).alias("monetary")).collect())


def test_join_of_equal_buckets_has_no_exchange(spark, scratch):
    table, requests = _save(_table(spark), scratch), _save(_requests(spark), scratch)
    out = lookup.lookup_bucketed(requests, table, 8)
    plan = _plan(out)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert _rows(out) == _rows(rules.lookup_rfm(_requests(spark), _table(spark)))


def test_hot_client_is_not_in_the_bucket_join(spark, scratch):
    plain = _requests(spark, 0.5)
    table, requests = _save(_table(spark), scratch), _save(plain, scratch)
    assert lookup.hot_clients(requests, 8, min_hot_rows=100) == ["10.0.0.7"]
    assert lookup.hot_clients(requests, 8) == []
    out = lookup.lookup_bucketed(requests, table, 8, min_hot_rows=100)
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert _rows(out) == _rows(rules.lookup_rfm(plain, _table(spark)))


def test_point_read_opens_one_bucket(spark, scratch):
    table = _save(_table(spark), scratch)
    one = rules.lookup_point(table, "10.0.0.42")
    assert [tuple(r) for r in one.collect()] == [("10.0.0.42", 42.0, 84.0, 63.0)]
    # a task per file, as the files are small: only one is opened
    assert table.rdd.getNumPartitions() == 8
    assert table.where(F.col("client_ip") == "10.0.0.42").rdd.getNumPartitions() == 1
    assert [tuple(r)[1] for r in rules.lookup_point(table, "nobody").collect()] == [-1.0]


def test_empty_sides(spark, scratch):
    none = _save(_table(spark).where("false"), scratch)
    requests = _save(_requests(spark), scratch)
    assert {r[2:] for r in _rows(lookup.lookup_bucketed(requests, none, 8))} == {(-1.0, -1.0, -1.0)}
    assert _rows(lookup.lookup_bucketed(_save(_requests(spark).where("false"), scratch), none, 8)) == []
