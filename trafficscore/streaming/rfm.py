"""Continuously maintained raw RFM measures per client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficscore.functions.scalars import epoch_micros
from trafficscore.operators.rfm import SECONDS_PER_DAY, as_timestamp_lit
from trafficscore.plans.strategies import released_after
from trafficscore.sources.versions import N_BUCKETS, VersionedTable


def stream_rfm_raw(logs: DataFrame, ts_col: str = "timestamp", key_col: str = "client_ip",
                   monetary_col: str | None = "http_body_length") -> DataFrame:
    """Running ``last_seen``, ``frequency`` and ``monetary`` per client.

    A streaming aggregation (partial aggregation per micro-batch, state per
    client in the state store); recency is relative to a reference time and
    is therefore computed when the table is written (``write_rfm_stream``).
    """
    aggs = [F.max(F.col(ts_col)).alias("last_seen"), F.count(F.col(ts_col)).alias("frequency")]
    if monetary_col is not None and monetary_col in logs.columns:
        aggs.append(F.coalesce(F.sum(F.col(monetary_col)), F.lit(0)).alias("monetary"))
    return logs.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(*aggs)


def rfm_table_from_state(agg: DataFrame, now=None, key_col: str = "client_ip") -> DataFrame:
    """Raw RFM table from the running aggregates (recency in days vs ``now``;
    the current time when ``now`` is None)."""
    ref = as_timestamp_lit(now) if now is not None else F.current_timestamp()
    recency = ((epoch_micros(ref) - epoch_micros(F.col("last_seen"))) / F.lit(1e6)) / F.lit(float(SECONDS_PER_DAY))
    cols = [key_col, recency.alias("recency_days"), "frequency"] + (["monetary"] if "monetary" in agg.columns else [])
    return agg.select(*cols)


def write_rfm_stream(agg: DataFrame, path: str, checkpoint: str, now=None, key_col: str = "client_ip",
                     fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Keep an RFM table current: every micro-batch overwrites ``path`` with
    the full table (complete mode) and recency relative to ``now``."""
    def write(batch: DataFrame, _id: int) -> None:
        out = rfm_table_from_state(batch, now, key_col).write.mode("overwrite").format(fmt)
        (out.option("header", "true") if fmt == "csv" else out).save(path)

    return (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"processingTime": "1 hour"})).start())


def upsert_rfm_stream(agg: DataFrame, path: str, checkpoint: str, key_col: str = "client_ip",
                      trigger: dict | None = None, n_buckets: int = N_BUCKETS) -> StreamingQuery:
    """Keep the running aggregates in a versioned table: every micro-batch upserts the clients
    that it changed (update mode) and rewrites only their buckets.  Readers see whole versions; a batch
    replayed after a failure is told by its number and left out.  Recency depends on the time of
    reading: ``read_rfm_versions``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path, key_col, n_buckets)
        if table.tag() != str(batch_id):
            with released_after():
                table.upsert(batch, tag=str(batch_id))

    return (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or {"processingTime": "1 hour"})).start())


def read_rfm_versions(table: VersionedTable, now=None, version: int | None = None) -> DataFrame | None:
    """Raw RFM table of a version (the newest) kept by ``upsert_rfm_stream``, None before the first rows."""
    rows = table.read(version)
    return None if rows is None else rfm_table_from_state(rows, now, table.key)
