"""End-to-end batch jobs.

Each job is one idempotent run meant for an external scheduler (the
reference sleeps in a loop; here cadence belongs to the cluster's
scheduler, or to ``streaming`` with a processing-time trigger).
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trafficscore.operators.clean import clean_packets, conform_access_log, exclude_static
from trafficscore.operators.rfm import compute_rfm, packet_measures, raw_from_measures, rfm_raw_packets
from trafficscore.operators.score import RFM_BINS, score_rfm
from trafficscore.plans.strategies import materialize, released_after
from trafficscore.schemas import ACCESS_LOG_COLUMNS, ACCESS_ROLES, SLIM_PACKET_COLUMNS, ColumnRoles
from trafficscore.session import ensure_utc
from trafficscore.sources.hwm import load_high_water_mark, save_high_water_mark
from trafficscore.sources.logs import read_access_log, read_packet_csv, require_columns
from trafficscore.sources.sinks import snapshot_path, write_rfm_table, write_scores_snapshot

log = logging.getLogger(__name__)


def _utcnow() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _read_access(spark: SparkSession, log_path, fmt_in: str, roles: ColumnRoles = ACCESS_ROLES) -> DataFrame:
    """Access log from CSV files, from Parquet landed by ``land_logs``, or a
    DataFrame given as is.  As in the original job, an unreadable CSV file is
    logged and skipped."""
    if not isinstance(log_path, str):
        return log_path
    if fmt_in == "parquet":
        return spark.read.parquet(log_path)
    own = [c for c in (roles.ts_col, roles.key_col, roles.monetary_col) if c]
    return read_access_log(spark, log_path, columns=list(dict.fromkeys([*own, *ACCESS_LOG_COLUMNS])),
                           required=(roles.ts_col, roles.key_col), skip_unreadable=True)


def refresh_rfm(spark: SparkSession, log_path: str | DataFrame, output_path: str, now: dt.datetime | None = None,
                roles: ColumnRoles = ACCESS_ROLES, fmt: str = "csv", on_bad_ts: str = "null",
                single_file: bool = False, fmt_in: str = "csv", source_tz: str | None = None) -> int:
    """Recompute the raw RFM table from the whole access log and overwrite it.

    ``source_tz`` is the zone that naive log times were written in (default UTC).

    Returns the number of clients written (counted while writing, through an
    ``Observation``, not by a second pass).  Empty input -> nothing written.
    """
    ensure_utc(spark)
    raw = _read_access(spark, log_path, fmt_in, roles)
    require_columns(raw, [roles.ts_col, roles.key_col])
    logs = conform_access_log(raw, on_bad_ts=on_bad_ts, source_tz=source_tz, ts_col=roles.ts_col,
                              monetary_col=roles.monetary_col)
    logs = exclude_static(logs) if "path" in logs.columns else logs
    if logs.isEmpty():
        log.info("no data - skipped")
        return 0
    now = now or _utcnow()
    monetary = roles.monetary_col if roles.monetary_col in logs.columns else None
    rfm = compute_rfm(logs, now, ts_col=roles.ts_col, key_col=roles.key_col, monetary_col=monetary)
    obs = Observation("rfm_rows")
    with released_after():
        # counted above the sort, whose sampling reads what stands below it once more
        ordered = rfm.orderBy(roles.key_col).observe(obs, F.count(F.lit(1)).alias("rows"))
        write_rfm_table(ordered, output_path, fmt=fmt, single_file=single_file, sort=False)
    rows = obs.get["rows"]
    log.info("RFM table saved (%d rows)", rows)
    return rows


def run_incremental(spark: SparkSession, log_path: str | DataFrame, output_dir: str, hwm_path: str,
                    now: dt.datetime | None = None, hwm: str = "run_time", rank_method: str = "histogram",
                    single_file: bool = False, fmt: str = "csv", fmt_in: str = "csv",
                    source_tz: str | None = None, bins: int = RFM_BINS) -> str | None:
    """Score only packet rows newer than the high-water mark.

    Scores use the new rows alone (never merged with history; see
    ``operators.score.merge_scores`` for an upsert).  The mark is written
    only after the snapshot is committed; an empty run leaves it unchanged.
    ``hwm="run_time"`` stores the run's wall-clock time, ``"event_max"`` the
    newest event time read (no row stamped before the run but landed after
    it is lost).  Returns the snapshot path, or None when nothing was new.
    """
    ensure_utc(spark)
    if hwm not in ("run_time", "event_max"):
        raise ValueError("hwm must be 'run_time' or 'event_max'")
    since = load_high_water_mark(spark, hwm_path)
    if isinstance(log_path, str):
        # Parquet landed by date (sinks.land_logs) lets the mark prune whole days
        raw = spark.read.parquet(log_path) if fmt_in == "parquet" else read_packet_csv(spark, log_path)
    else:
        raw = log_path
    with released_after():
        require_columns(raw, SLIM_PACKET_COLUMNS)
        logs = materialize(clean_packets(raw, since=since, source_tz=source_tz,
                                         partition_col="date" if "date" in raw.columns and fmt_in == "parquet" else None))
        if logs.isEmpty():
            log.info("no new rows since %s", since.isoformat())
            return None
        now = now or _utcnow()
        scores = score_rfm(rfm_raw_packets(logs, now), last_updated=now.isoformat(),
                           rank_method=rank_method, bins=bins)
        path = write_scores_snapshot(scores, output_dir, now, single_file=single_file, fmt=fmt)
        if hwm == "event_max":
            us = logs.agg(F.unix_micros(F.max(F.col("timestamp").cast("timestamp")))).first()[0]
            mark = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)
        else:
            mark = now
    save_high_water_mark(spark, hwm_path, mark)
    return path


def run_merged(spark: SparkSession, log_path: str | list[str], output_dir: str, state_path: str, now: dt.datetime | None = None,
               settle_seconds: float = 0, bins: int = RFM_BINS, single_file: bool = False, fmt: str = "csv",
               source_tz: str | None = None) -> str | None:
    """Score all clients after adding the packet files that no earlier run has read.

    The measures of each client (last request, requests, bytes) stand in a versioned table under
    ``state_path``.  A run aggregates the new files, merges the result into the buckets it
    touches, and scores the whole table, so ranks are over all of history although old logs
    aren't read again: the scores after any number of runs are those of one run over all files.
    Files and measures are committed by one manifest, each file counts once.  A run that
    died before its snapshot was whole is made up for by the next one, for the time it ran.
    Returns the snapshot's path, or None when there was nothing to do.
    """
    from trafficscore.sources.ledger import LEDGER, unread_files
    from trafficscore.sources.versions import VersionedTable, path_exists

    ensure_utc(spark)
    now = now or _utcnow()
    table = VersionedTable(spark, state_path, "src_ip")
    with released_after():
        files = materialize(unread_files(table, log_path, settle_seconds, now))
        paths = [r["path"] for r in files.select("path").collect()]     # the reader lists them in the driver anyway
        if paths:
            logs = clean_packets(read_packet_csv(spark, paths), source_tz=source_tz)
            table.upsert(packet_measures(logs), combine={"last_seen": "max", "frequency_raw": "sum", "monetary_raw": "sum"},
                         tag=now.isoformat(), notes={LEDGER: files})
        else:
            last = table.tag()
            if last is None or path_exists(spark, snapshot_path(output_dir, dt.datetime.fromisoformat(last)) + "/_SUCCESS"):
                log.info("no new files")
                return None
            now = dt.datetime.fromisoformat(last)
        scores = score_rfm(raw_from_measures(table.read(), now), last_updated=now.isoformat(), bins=bins)
        return write_scores_snapshot(scores, output_dir, now, single_file=single_file, fmt=fmt)


def refresh_from_config(spark: SparkSession, cfg=None, now: dt.datetime | None = None) -> int:
    """``refresh_rfm`` with the deployment's settings (``config.from_env()``)."""
    from trafficscore.config import from_env
    cfg = cfg or from_env()
    roles = ColumnRoles(ts_col=cfg.ts_col, key_col=cfg.ip_col, monetary_col=cfg.monetary_col)
    return refresh_rfm(spark, cfg.network_log_dir, cfg.output_file, now=now, roles=roles, source_tz=cfg.source_tz)


def incremental_from_config(spark: SparkSession, cfg=None, now: dt.datetime | None = None) -> str | None:
    """``run_incremental`` with the deployment's settings (``config.from_env()``)."""
    from trafficscore.config import from_env
    cfg = cfg or from_env()
    return run_incremental(spark, cfg.log_data_path, cfg.rfm_output_dir, cfg.last_run_file, now=now,
                           source_tz=cfg.source_tz, bins=cfg.rfm_bins)


def decide_job(spark: SparkSession, log_path: str | DataFrame, rfm_path: str | DataFrame, output_path: str,
               window_seconds: float = 60, limit: int = 10, tie_col: str | None = None,
               verified: DataFrame | None = None, unknown_policy: str = "compat", verdict_kw: dict | None = None,
               fmt: str = "parquet", fmt_in: str = "csv", source_tz: str | None = None) -> int:
    """Offline decision run: access-log files + RFM table file -> allow /
    challenge per protected request, written to ``output_path``.

    Returns the number of challenged requests (observed while writing).
    """
    from trafficscore.operators.rules import build_lookup_table, decide_requests
    from trafficscore.sources.logs import read_rfm_table

    ensure_utc(spark)
    raw = _read_access(spark, log_path, fmt_in)
    require_columns(raw, ["timestamp", "client_ip", "path"])
    logs = exclude_static(conform_access_log(raw, source_tz=source_tz))
    rfm = read_rfm_table(spark, rfm_path) if isinstance(rfm_path, str) else rfm_path
    with released_after():
        table = build_lookup_table(rfm)
        out = decide_requests(logs, table, tie_col=tie_col, window_seconds=window_seconds, limit=limit,
                              verified=verified, unknown_policy=unknown_policy, verdict_kw=verdict_kw)
        obs = Observation("decisions")
        (out.observe(obs, F.sum((F.col("decision") == "challenge").cast("long")).alias("challenged"))
         .write.mode("overwrite").format(fmt).save(output_path))
        return int(obs.get["challenged"] or 0)
