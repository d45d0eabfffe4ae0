"""Recency / frequency / monetary aggregation per client.

One ``groupBy(key).agg(...)``: Spark plans a partial (map-side) hash
aggregate, one shuffle on the key and a final aggregate, so a client that
owns a third of all rows still reaches the shuffle as one row per map task.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficscore.functions.scalars import epoch_micros

log = logging.getLogger(__name__)

SECONDS_PER_DAY = 86_400


def as_timestamp_lit(now) -> Column:
    """A fixed reference time as a timestamp literal (naive = UTC wall clock)."""
    if isinstance(now, dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
        now = now.isoformat(sep=" ")
    return F.lit(str(now)).cast("timestamp")


def compute_rfm(df: DataFrame, now, ts_col: str = "timestamp", key_col: str = "client_ip",
                monetary_col: str | None = "http_body_length") -> DataFrame:
    """Per-client recency in days, frequency and monetary sum.

    * ``recency_days`` = (now - latest timestamp) in seconds / 86400;
    * ``frequency`` counts rows with a non-NULL timestamp (a client whose
      rows all lack a time has frequency 0 and NULL recency);
    * ``monetary`` sums ``monetary_col`` (NULLs skipped, all-NULL -> 0).  When
      the column is absent (or ``None``) only R and F are returned.
    Rows with a NULL client key are dropped.
    """
    aggs = [F.max(F.col(ts_col)).alias("_last"), F.count(F.col(ts_col)).alias("frequency")]
    has_monetary = monetary_col is not None and monetary_col in df.columns
    if monetary_col is not None and not has_monetary:
        log.warning("monetary column %r not found - returning R and F only", monetary_col)
    if has_monetary:
        aggs.append(F.coalesce(F.sum(F.col(monetary_col)), F.lit(0)).alias("monetary"))
    g = df.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(*aggs)
    diff_us = epoch_micros(as_timestamp_lit(now)) - epoch_micros(F.col("_last"))
    recency = (diff_us / F.lit(1e6)) / F.lit(float(SECONDS_PER_DAY))
    cols = [key_col, recency.alias("recency_days"), "frequency"] + (["monetary"] if has_monetary else [])
    return g.select(*cols)


def packet_measures(logs: DataFrame, ts_col: str = "timestamp", key_col: str = "src_ip",
                    length_col: str = "pkt_len") -> DataFrame:
    """Packet-path measures that merge: ``last_seen``, ``frequency_raw`` (all rows) and
    ``monetary_raw`` (byte sum) per client."""
    return logs.groupBy(key_col).agg(F.max(F.col(ts_col)).alias("last_seen"),
                                     F.count(F.lit(1)).alias("frequency_raw"),
                                     F.sum(F.col(length_col)).alias("monetary_raw"))


def raw_from_measures(measures: DataFrame, now) -> DataFrame:
    """``measures`` with ``recency_raw`` in whole seconds."""
    recency = F.unix_seconds(as_timestamp_lit(now)) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return measures.withColumn("recency_raw", recency)


def rfm_raw_packets(logs: DataFrame, now, ts_col: str = "timestamp", key_col: str = "src_ip",
                    length_col: str = "pkt_len") -> DataFrame:
    """Packet-path raw measures: ``last_seen``, ``frequency_raw`` (all rows),
    ``monetary_raw`` (byte sum) and ``recency_raw`` in whole seconds."""
    return raw_from_measures(packet_measures(logs, ts_col, key_col, length_col), now)


def traffic_totals(df: DataFrame, key_cols=None, length_col: str | None = "length") -> DataFrame:
    """Packet (row) and byte totals, overall or per key (e.g. per source)."""
    aggs = [F.count(F.lit(1)).alias("packets")]
    if length_col is not None:
        aggs.append(F.coalesce(F.sum(F.col(length_col)), F.lit(0)).alias("bytes"))
    if not key_cols:
        return df.agg(*aggs)
    return df.groupBy(*([key_cols] if isinstance(key_cols, str) else key_cols)).agg(*aggs)
