"""Cleaning, conforming and narrowing of log rows (filters and projections).

Every function is a lazy select/where over built-in expressions, so Catalyst
can prune columns and push the NULL tests into the file scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trafficscore.functions.scalars import parse_timestamp, tcp_flags_string, whole_number

# Defaults of absent access-log fields.
ACCESS_DEFAULTS = {"src_port": "N/A", "http_body_length": 0, "user_agent": "", "referer": ""}

# Protected route (with and without the trailing slash).
PROTECTED_PATHS = ("/sensitive-data", "/sensitive-data/")

# IP protocol numbers that carry ports; TCP also carries flags.
PROTO_TCP = 6
PROTO_UDP = 17


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def localize(ts, source_tz: str | None):
    """Wall-clock times written in ``source_tz`` -> UTC (the session zone)."""
    return ts if not source_tz else F.to_utc_timestamp(ts, source_tz)


def conform_access_log(df: DataFrame, on_bad_ts: str = "null", source_tz: str | None = None,
                       ts_col: str = "timestamp", monetary_col: str | None = "http_body_length") -> DataFrame:
    """Typed access log with the defaults of absent fields.

    ``timestamp`` text is parsed (NULL when unparseable unless
    ``on_bad_ts="error"``) and, when the log was written in local time,
    moved from ``source_tz`` to UTC; the monetary column becomes a number (text
    keeps its decimals) with 0 for absent; ``src_port`` stays text with ``N/A``; agent/referer
    default ''.
    """
    ts = parse_timestamp(ts_col, on_bad=on_bad_ts) if _is_string(df, ts_col) else F.col(ts_col).cast("timestamp")
    out = {ts_col: localize(ts, source_tz)}
    if monetary_col is not None and monetary_col in df.columns:
        value = F.col(monetary_col)
        if _is_string(df, monetary_col):
            value = value.try_cast("double")
        out[monetary_col] = F.coalesce(value, F.lit(ACCESS_DEFAULTS["http_body_length"]))
    if "src_port" in df.columns:
        out["src_port"] = F.coalesce(F.col("src_port").cast("string"), F.lit(ACCESS_DEFAULTS["src_port"]))
    out |= {c: F.coalesce(F.col(c), F.lit("")) for c in ("user_agent", "referer") if c in df.columns}
    return df.withColumns(out)


def exclude_static(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Drop requests for static assets (paths starting with ``/static``)."""
    # written as IS NULL OR NOT STARTSWITH so the file scan can take it as a pushed filter
    return df.where(F.col(path_col).isNull() | ~F.col(path_col).startswith("/static"))


def protected_requests(df: DataFrame, path_col: str = "path", paths=PROTECTED_PATHS,
                       verified: DataFrame | None = None, key_col: str = "client_ip") -> DataFrame:
    """Requests to the protected route, minus clients already verified.

    ``verified`` (one column ``key_col``) is removed with a left anti join:
    broadcast when the distinct verified clients are within the counted
    bound, else a shuffle anti join (AQE splits a hot client's partition).
    """
    from trafficscore.plans.strategies import BROADCAST_MAX_ROWS, materialize

    out = df.where(F.col(path_col).isin(list(paths)))
    if verified is not None:
        keys = materialize(verified.select(key_col).distinct())
        side = F.broadcast(keys) if keys.count() <= BROADCAST_MAX_ROWS else keys
        out = out.join(side, on=key_col, how="left_anti")
    return out


def slim_packets(packets: DataFrame) -> DataFrame:
    """Full packet record -> the three converter columns (text timestamp,
    source address, length).  Input: the raw fields of ``parse_packet_lines``."""
    raw = {"Timestamp", "SrcIP", "DstIP", "Proto", "SrcPort", "DstPort", "Length", "Flags", "line", "kind",
           "n_fields"}
    keep = [c for c in packets.columns if c not in raw]
    return packets.select(*keep, F.col("Timestamp").alias("timestamp"), F.col("SrcIP").alias("src_ip"),
                          F.col("Length").alias("pkt_len"))


def conform_packets(df: DataFrame, source_tz: str | None = None) -> DataFrame:
    """Slim packet rows typed: ``timestamp`` parsed (NULL when unparseable),
    ``src_ip`` kept, ``pkt_len`` as a long (decimals cut off, NULL when no number).
    Other columns pass through."""
    ts = parse_timestamp("timestamp") if _is_string(df, "timestamp") else F.col("timestamp").cast("timestamp")
    keep = [c for c in df.columns if c not in ("timestamp", "src_ip", "pkt_len")]
    return df.select(*keep, localize(ts, source_tz).alias("timestamp"), F.col("src_ip"),
                     whole_number("pkt_len").alias("pkt_len"))


def clean_packets(df: DataFrame, since: dt.datetime | None = None, source_tz: str | None = None,
                  partition_col: str | None = None) -> DataFrame:
    """Slim packet rows -> (timestamp, src_ip, pkt_len long) with hygiene rules.

    Keeps rows with a parseable timestamp, a source address and a length that
    is a number of at least 0; ``since`` adds the strict ``timestamp > since``
    filter of the incremental job; ``source_tz`` reads local capture times.
    """
    out = conform_packets(df, source_tz)
    if since is not None:
        out = filter_since(out, since, partition_col=partition_col)
    return out.where(F.col("src_ip").isNotNull() & (F.col("pkt_len") >= 0) & F.col("timestamp").isNotNull())


def filter_since(df: DataFrame, since, ts_col: str = "timestamp", partition_col: str | None = None) -> DataFrame:
    """Rows strictly newer than ``since`` (a datetime or timestamp text).

    A naive datetime is taken as UTC wall clock, like the logs.  For a table
    partitioned by UTC date (``sinks.land_logs``), pass ``partition_col``: the
    matching date bound is added so whole older days are pruned (Spark
    cannot derive a partition filter from the timestamp predicate itself).
    """
    if isinstance(since, dt.datetime) and since.tzinfo is not None:
        since = since.astimezone(dt.timezone.utc).replace(tzinfo=None)
    lit = F.lit(since.isoformat(sep=" ") if isinstance(since, dt.datetime) else since)
    out = df.where(F.col(ts_col).cast("timestamp") > lit.cast("timestamp"))
    if partition_col and partition_col in df.columns:
        out = out.where(F.col(partition_col) >= F.to_date(lit.cast("timestamp")))
    return out


def filter_destination(df: DataFrame, host: str, port: int | None = None,
                       dst_col: str = "dst_ip", port_col: str = "dst_port") -> DataFrame:
    """``dst host X [and dst port P]`` on decoded packet rows (a pushed-down
    equality on Parquet)."""
    cond = F.col(dst_col) == F.lit(host)
    if port is not None:
        cond = cond & (F.col(port_col) == F.lit(port))
    return df.where(cond)


def normalize_flow_fields(df: DataFrame, proto_col: str = "proto", src_port_col: str = "src_port",
                          dst_port_col: str = "dst_port", flags_col: str | None = "flags",
                          flag_mask_col: str | None = None, ip_version_col: str | None = None,
                          ihl_col: str | None = None) -> DataFrame:
    """Protocol-conditional fields of a packet row.

    Ports are kept for TCP/UDP and 0 otherwise; flags are the ``UAPRSF``
    string for TCP (from ``flag_mask_col`` when given) and ``-`` otherwise.
    When the table carries IP version / header-length columns, only IPv4 rows
    with a header of at least 20 bytes are kept.
    """
    proto = F.col(proto_col)
    has_ports = proto.isin(PROTO_TCP, PROTO_UDP)
    cols = {
        src_port_col: F.when(has_ports, F.coalesce(F.col(src_port_col), F.lit(0))).otherwise(F.lit(0)),
        dst_port_col: F.when(has_ports, F.coalesce(F.col(dst_port_col), F.lit(0))).otherwise(F.lit(0)),
    }
    if flags_col is not None:
        flags: Column = tcp_flags_string(flag_mask_col) if flag_mask_col else F.col(flags_col)
        cols[flags_col] = F.when(proto == PROTO_TCP, flags).otherwise(F.lit("-"))
    out = df.withColumns(cols)
    if ip_version_col is not None:
        out = out.where(F.col(ip_version_col) == 4)
    if ihl_col is not None:
        out = out.where(F.col(ihl_col) * 4 >= 20)
    return out
