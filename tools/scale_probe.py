"""Scale probe: amplified driver data, timings of the single-task plans
against their distributed forms.

The events table is replicated ``k`` times with Spark (``explode`` of a
copy index, each copy shifted by the table's time span) and written once
under the checkpoint folder; one client is then given a third of all rows.

usage: python tools/scale_probe.py [sf_dir] [copies]
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from trafficscore.operators.ranks import percent_rank_column  # noqa: E402
from trafficscore.operators.ratelimit import rate_limit_batch  # noqa: E402
from trafficscore.plans import views as V  # noqa: E402
from trafficscore.session import build_session, checkpoint_dir  # noqa: E402


def timed(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 2)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 50
    spark = build_session("local[8]", shuffle_partitions=32)
    ev = V.table(spark, sf, "events")
    span = ev.agg((F.unix_seconds(F.max(F.col("ts").cast("timestamp")))
                   - F.unix_seconds(F.min(F.col("ts").cast("timestamp"))) + 1).alias("s")).first()["s"]
    n = ev.count()
    big = (ev.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
           .select((F.col("event_id") + F.col("copy") * F.lit(n)).alias("event_id"),
                   (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("copy") * F.lit(span)))
                   .cast("timestamp_ntz").alias("ts"),
                   # every third event goes to one hot client
                   F.when(F.pmod(F.col("event_id") + F.col("copy"), F.lit(3)) == 0, F.lit(7))
                   .otherwise(F.col("user_id")).alias("user_id"),
                   "event_type", "value", "props"))
    path = f"{checkpoint_dir(spark)}/scale-probe-{k}"
    big.write.mode("overwrite").parquet(f"{path}/events.parquet")
    acc = V.access_log_from(spark.read.parquet(f"{path}/events.parquet"))
    rows = acc.count()
    out = {"rows": rows, "copies": k}
    out["rank_window_s"] = timed(percent_rank_column(acc, "http_body_length", "pr", method="window"))
    out["rank_histogram_s"] = timed(percent_rank_column(acc, "http_body_length", "pr", method="histogram"))
    kw = dict(tie_col="request_id", window_seconds=60, limit=10)
    out["limiter_single_fold_s"] = timed(rate_limit_batch(acc, split_hot_clients=False, **kw))
    out["limiter_split_s"] = timed(rate_limit_batch(acc, min_hot_rows=100_000, **kw))
    a = rate_limit_batch(acc, split_hot_clients=False, **kw).select("request_id", "request_count").alias("a")
    b = rate_limit_batch(acc, min_hot_rows=100_000, **kw).select("request_id", "request_count").alias("b")
    out["limiter_results_differ"] = a.join(b, "request_id").where(
        F.col("a.request_count") != F.col("b.request_count")).count()
    # skewed lookup join (a third of the requests carry one key), shuffle path
    from trafficscore.operators import rfm, rules
    from trafficscore.plans.strategies import size_checked_join
    table = rules.build_lookup_table(rfm.compute_rfm(acc, V.EVENTS_NOW)).select(
        "client_ip", "recency_days", "frequency", "monetary")
    table.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    out["join_plain_shuffle_s"] = timed(acc.join(table, "client_ip", "left"))
    out["join_salted_s"] = timed(size_checked_join(acc, table, ["client_ip"], how="left", broadcast_max_rows=0))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    out["join_plain_aqe_skew_s"] = timed(acc.join(table, "client_ip", "left"))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
