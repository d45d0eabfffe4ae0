"""Sinks for RFM tables, scored snapshots and logs.

Writers never pull data through the driver.  ``single_file`` (one part
file, as the reference's CSV outputs) is opt-in: it funnels the table into
one task and is only sensible for small outputs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.schemas import SCORES_JDBC_COLUMN_TYPES


def _writer(df: DataFrame, fmt: str, mode: str, single_file: bool):
    out = df.coalesce(1) if single_file else df
    w = out.write.format(fmt).mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    return w


def write_rfm_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False,
                    sort: bool = True) -> None:
    """Overwrite the raw RFM table (header row, no index column), ordered by
    client key, its first column (a distributed range sort), unless it is
    so already."""
    _writer(df.orderBy(df.columns[0]) if sort else df, fmt, "overwrite", single_file).save(path)


def snapshot_path(out_dir: str, run_time: dt.datetime) -> str:
    """``<out_dir>/rfm_scores_<YYYYmmddTHHMMSSZ>.csv`` for a UTC run time."""
    if run_time.tzinfo is not None:
        run_time = run_time.astimezone(dt.timezone.utc)
    return f"{out_dir.rstrip('/')}/rfm_scores_{run_time:%Y%m%dT%H%M%SZ}.csv"


def write_scores_snapshot(scores: DataFrame, out_dir: str, run_time: dt.datetime, sort: bool = True,
                          single_file: bool = False, fmt: str = "csv") -> str:
    """Write a timestamped scored table, ordered by address (a distributed
    range sort; part files are in key order).  Returns the path."""
    path = snapshot_path(out_dir, run_time)
    df = scores.orderBy("src_ip") if sort else scores
    _writer(df, fmt, "overwrite", single_file).save(path)
    return path


def scores_for_jdbc(scores: DataFrame) -> DataFrame:
    """Projection matching the relational table: float scores, text time."""
    return scores.select(
        F.col("src_ip").cast("string"),
        *[F.col(c).cast("float").alias(c) for c in ("r_score", "f_score", "m_score", "composite_score")],
        F.col("last_updated").cast("string"),
    )


def write_scores_jdbc(scores: DataFrame, options: dict, mode: str = "overwrite",
                      num_partitions: int | None = None) -> None:
    """Replace the contents of the scores table.

    ``truncate`` keeps the existing table (and its primary key) instead of
    dropping it; ``numPartitions`` bounds concurrent connections.
    """
    df = scores_for_jdbc(scores)
    if num_partitions:
        df = df.coalesce(num_partitions)
    (df.write.format("jdbc").options(**options).option("truncate", "true")
     .option("createTableColumnTypes", SCORES_JDBC_COLUMN_TYPES).mode(mode).save())


def rotation_bucket(ts_col: str = "timestamp", seconds: int = 3600) -> F.Column:
    """Rotation bucket name ``netlog_YYYYmmdd_HHMMSS`` (start of the bucket)."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts_col).cast("timestamp")) / seconds) * seconds)
    return F.coalesce(F.concat(F.lit("netlog_"), F.date_format(start, "yyyyMMdd_HHmmss")), F.lit("netlog_unknown"))


def sink_rotating_csv(df: DataFrame, path: str, ts_col: str = "timestamp", rotate_seconds: int = 3600,
                      mode: str = "append") -> None:
    """Batch form of the hourly rotated CSV: one folder per rotation bucket
    (``rotation=netlog_...``), header in every file."""
    (df.withColumn("rotation", rotation_bucket(ts_col, rotate_seconds))
     .write.mode(mode).option("header", "true").partitionBy("rotation").csv(path))


def append_access_log(df: DataFrame, path: str) -> None:
    """Append request rows to the access-log folder (each file has a header)."""
    df.write.mode("append").option("header", "true").csv(path)


def land_logs(df: DataFrame, path: str, ts_col: str = "timestamp", partition_col: str = "date",
              mode: str = "append") -> None:
    """Land log rows as Parquet partitioned by UTC date of ``ts_col``, so
    time-bounded reads (``filter_since(..., partition_col=)``) prune whole
    days instead of scanning every file."""
    (df.withColumn(partition_col, F.to_date(F.col(ts_col).cast("timestamp")))
     .write.mode(mode).partitionBy(partition_col).parquet(path))
