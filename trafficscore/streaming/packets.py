"""Packet TSV -> slim CSV, continuously (the converter as a stream)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficscore.functions.scalars import PACKET_TS_PATTERN, parse_timestamp
from trafficscore.operators.clean import slim_packets
from trafficscore.sources.logs import parse_packet_lines


def read_packet_tsv_stream(spark: SparkSession, input_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New TSV files of a folder as a stream of lines (column ``value``).

    Files are read once and whole, when they appear.  For logs that grow, and to start at
    their end, use ``sources.tail.tail_lines``; ``start_ts`` of ``stream_packet_tsv``
    ignores packets older than the start.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(input_dir)


def slim_packet_stream(lines: DataFrame, line_col: str = "value", start_ts: dt.datetime | str | None = None) -> DataFrame:
    """Good lines only, narrowed to ``timestamp, src_ip, pkt_len`` (text, as
    the converter writes them) plus the rotation bucket of each packet.

    Per micro-batch line counts by kind (ok / malformed / missing / skip)
    are reported as observed metrics ``packet_lines`` in the query progress,
    in place of a log line per rejected line."""
    parsed = parse_packet_lines(lines, line_col).observe(
        "packet_lines", *[F.sum((F.col("kind") == k).cast("long")).alias(k)
                          for k in ("ok", "malformed", "missing", "skip")])
    ok = parsed.where(F.col("kind") == "ok")
    slim = slim_packets(ok)
    ts = parse_timestamp(F.col("timestamp"), patterns=(PACKET_TS_PATTERN,))
    if start_ts is not None:
        slim = slim.where(ts >= F.lit(str(start_ts)).cast("timestamp"))
    return slim.withColumn("rotation", rotation_bucket_expr(ts))


def rotation_bucket_expr(ts, seconds: int = 3600):
    start = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)
    return F.coalesce(F.concat(F.lit("netlog_"), F.date_format(start, "yyyyMMdd_HHmmss")), F.lit("netlog_unknown"))


def stream_packet_tsv(lines: DataFrame, output_path: str, checkpoint: str, trigger: dict | None = None,
                      line_col: str = "value", start_ts=None, keep_cols=()) -> StreamingQuery:
    """Start the converter: TSV lines -> CSV files with a header, one folder
    per hour of packet time (``rotation=netlog_YYYYmmdd_HH0000``)."""
    slim = slim_packet_stream(lines, line_col, start_ts).select(*keep_cols, "timestamp", "src_ip", "pkt_len",
                                                                 "rotation")
    w = (slim.writeStream.format("csv").option("header", "true").option("checkpointLocation", checkpoint)
         .partitionBy("rotation").outputMode("append"))
    return w.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start(output_path)


__all__ = ["read_packet_tsv_stream", "slim_packet_stream", "stream_packet_tsv", "rotation_bucket_expr",
           "stream_access_log", "stream_land_logs"]


def stream_access_log(requests: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append request rows to the access-log folder as CSV with a header
    (the file sink commits each micro-batch exactly once)."""
    return (requests.writeStream.format("csv").option("header", "true").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"processingTime": "1 second"})).start(path))


def stream_land_logs(logs: DataFrame, path: str, checkpoint: str, ts_col: str = "timestamp",
                     partition_col: str = "date", trigger: dict | None = None) -> StreamingQuery:
    """Continuously land log rows as Parquet partitioned by UTC date (the
    layout ``filter_since(partition_col=...)`` prunes), exactly once per
    micro-batch through the file sink."""
    out = logs.withColumn(partition_col, F.to_date(F.col(ts_col).cast("timestamp")))
    return (out.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy(partition_col)
            .outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start(path))
