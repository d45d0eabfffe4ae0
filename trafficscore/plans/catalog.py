"""Registered queries: one per operator, each reading the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over all
rows of the tables it reads.  Computed columns are aliased to the names the
oracle SQL (``trafficscore.plans.oracle``) uses; doubles that come from sums
or divisions are rounded the same way on both sides.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficscore.functions import scalars as X
from trafficscore.operators import clean, lookup, ranks, rfm, rules, score
from trafficscore.operators.ratelimit import rate_limit_batch
from trafficscore.plans import views as V
from trafficscore.schemas import SCORES_SCHEMA
from trafficscore.sources import logs as S

# Fixture parameters (chosen so every branch fires on the driver tables; the
# library defaults stay those of the reference).
LIMIT_WINDOW_S, LIMIT_N = 86_400, 3
VERDICT_KW = dict(max_recency_days=1, freq_pct=50, low_monetary=1800, high_monetary=3000)
CLASSIFY_KW = dict(low_recency=0.3, high_frequency=66, low_monetary=3200, high_monetary=3800)
HWM = "2024-01-15 00:00:00"


def _round(c, n):
    return F.round(F.col(c), n).alias(c)


# ---- RFM and rules on the access log --------------------------------------

def _access(spark, sf):
    return clean.exclude_static(V.access_log(spark, sf))


def q_compute_rfm(spark: SparkSession, sf: str) -> DataFrame:
    r = rfm.compute_rfm(_access(spark, sf), V.EVENTS_NOW)
    return r.select("client_ip", _round("recency_days", 9), "frequency", _round("monetary", 4))


def q_compute_rfm_no_monetary(spark, sf):
    r = rfm.compute_rfm(_access(spark, sf).drop("http_body_length"), V.EVENTS_NOW)
    return r.select("client_ip", _round("recency_days", 9), "frequency")


def q_customer_rfm(spark, sf):
    r = rfm.compute_rfm(V.customer_activity(spark, sf), V.ORDERS_NOW, key_col="client_id",
                        monetary_col="amount_cents")
    return r.select("client_id", _round("recency_days", 9), "frequency", "monetary")


def q_classify_clients(spark, sf):
    r = rfm.compute_rfm(_access(spark, sf), V.EVENTS_NOW)
    return rules.classify_clients(r, **CLASSIFY_KW).select("client_ip", "label")


def q_exclude_static(spark, sf):
    return _access(spark, sf).select("request_id", "client_ip", "path")


def _lookup_table(spark, sf, method="histogram", **kw):
    return rules.build_lookup_table(rfm.compute_rfm(_access(spark, sf), V.EVENTS_NOW), method=method, **kw)


def q_average_percentile(spark, sf):
    r = rfm.compute_rfm(_access(spark, sf), V.EVENTS_NOW)
    out = ranks.average_percentile(r, "frequency", out="frequency_pct")
    return out.select("client_ip", "frequency", _round("frequency_pct", 9))


def q_suspicion_verdict(spark, sf):
    t = _lookup_table(spark, sf)
    return rules.suspicion_verdict(t, **VERDICT_KW).select("client_ip", "suspicious")


def _lookup_sides(spark, sf):
    """Requests, and a table that lacks some clients and holds others twice; both are unknown."""
    one = rfm.compute_rfm(_access(spark, sf), V.EVENTS_NOW).where(F.pmod(V.last_octet(), F.lit(11)) != 0)
    table = rules.build_lookup_table(one.unionByName(one.where(F.pmod(V.last_octet(), F.lit(7)) == 0)))
    return clean.protected_requests(V.access_log(spark, sf)).select("request_id", "client_ip"), table


def q_lookup_rfm(spark, sf):
    out = rules.lookup_rfm(*_lookup_sides(spark, sf))
    return out.select("request_id", "client_ip", _round("recency_days", 9), _round("frequency", 9),
                      _round("monetary", 4))


LOOKUP_BUCKETS = 16


def q_lookup_bucketed(spark, sf):
    """Requests and table landed in buckets by client, then looked up without a shuffle; a client
    with over 30 requests and a bucket's share of them counts as hot."""
    requests, table = (
        lookup.save_bucketed(df, f"{kind}_{uuid.uuid4().hex}", _folder(spark, kind), n_buckets=LOOKUP_BUCKETS)
        for kind, df in zip(("requests", "rfm"), _lookup_sides(spark, sf), strict=True))
    out = lookup.lookup_bucketed(requests, table, LOOKUP_BUCKETS, min_hot_rows=30)
    return out.select("request_id", "client_ip", _round("recency_days", 9), _round("frequency", 9),
                      _round("monetary", 4))


POINT_IP = "10.0.0.7"


def q_lookup_point(spark, sf):
    table = _lookup_table(spark, sf)
    out = rules.verdict_for(table, POINT_IP, **VERDICT_KW)
    looked = rules.lookup_point(table, POINT_IP)
    return looked.join(out, "client_ip").select("client_ip", _round("recency_days", 9), _round("frequency", 9),
                                                _round("monetary", 4), "suspicious")


def q_rate_limit(spark, sf):
    out = rate_limit_batch(V.access_log(spark, sf), tie_col="request_id",
                           window_seconds=LIMIT_WINDOW_S, limit=LIMIT_N)
    return out.select("request_id", "client_ip", X.to_ntz("window_start").alias("window_start"),
                      "request_count", "over_limit")


SUBNET_WINDOW_S, SUBNET_N = 3_600, 20


def q_rate_limit_subnet(spark, sf):
    """The limiter keyed by /24 network instead of address.  Few networks
    carry all traffic (at sf0.01 a single one holds every row), so this runs
    the time slices of hot keys."""
    acc = V.access_log(spark, sf).withColumn(
        "subnet", F.concat(F.regexp_extract("client_ip", r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))
    # slices of 2,000 rows: the hot-network path runs at every scale and
    # whatever the session's partition count
    out = rate_limit_batch(acc, key_col="subnet", tie_col="request_id", window_seconds=SUBNET_WINDOW_S,
                           limit=SUBNET_N, hot_rows=2_000)
    return out.select("request_id", "subnet", X.to_ntz("window_start").alias("window_start"),
                      "request_count", "over_limit")


def q_decide_requests(spark, sf):
    out = rules.decide_requests(V.access_log(spark, sf), _lookup_table(spark, sf), tie_col="request_id",
                                window_seconds=LIMIT_WINDOW_S, limit=LIMIT_N, verdict_kw=VERDICT_KW)
    return out.select("request_id", "client_ip", "request_count", "over_limit", "suspicious", "decision")


def q_decide_unverified(spark, sf):
    """Some requests come from the loopback address, and a third of the clients is verified."""
    log = V.access_log(spark, sf)
    local = F.when(F.pmod(V.last_octet(), F.lit(10)) == 5, F.lit(rules.LOOPBACK)).otherwise(F.col("client_ip"))
    log = log.withColumn("client_ip", local)
    verified = log.where((F.pmod(V.last_octet(), F.lit(3)) == 0) & (F.col("client_ip") != rules.LOOPBACK))
    out = rules.decide_requests(log, _lookup_table(spark, sf), tie_col="request_id", verified=verified,
                                window_seconds=LIMIT_WINDOW_S, limit=LIMIT_N, verdict_kw=VERDICT_KW)
    return out.select("request_id", "client_ip", "request_count", "over_limit", "suspicious", "decision")


# ---- text logs: conforming and parsing ------------------------------------

def q_conform_access_log(spark, sf):
    out = clean.conform_access_log(V.access_log_text(spark, sf))
    return out.select("request_id", X.to_ntz("timestamp").alias("timestamp"), "src_port",
                      "http_body_length", "user_agent", "referer")


def _time_texts(e):
    ts = F.col("ts").cast("timestamp")
    k = F.pmod(F.col("event_id"), F.lit(4))
    text = (F.when(F.pmod(F.col("event_id"), F.lit(101)) == 0, F.lit("not-a-time"))
            .when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(X.format_packet_ts(ts)))
    return e.select("event_id", text.alias("text"))


def q_parse_timestamp(spark, sf):
    return _time_texts(V.table(spark, sf, "events")).select(
        "event_id", X.to_ntz(X.parse_timestamp("text")).alias("parsed"))


def q_parse_timestamp_strict(spark, sf):
    """The strict parse (an error on bad text) over the good texts."""
    good = _time_texts(V.table(spark, sf, "events").where(F.pmod(F.col("event_id"), F.lit(101)) != 0))
    return good.select("event_id", X.to_ntz(X.parse_timestamp("text", on_bad="error")).alias("parsed"))


def _lines(spark, sf):
    return V.packet_lines(spark, sf)


def _packets(spark, sf):
    return S.read_packet_tsv(_lines(spark, sf))


def _clean_packets(spark, sf, since=None):
    ok = S.parse_packet_lines(_lines(spark, sf)).where(F.col("kind") == "ok")
    return clean.clean_packets(clean.slim_packets(ok), since=since)


def q_packet_tsv_parse(spark, sf):
    p = _packets(spark, sf)
    return p.select("line_id", X.to_ntz("timestamp").alias("timestamp"), "src_ip", "dst_ip", "proto",
                    "src_port", "dst_port", "length", "flags")


def q_packet_rejects(spark, sf):
    return S.rejected_lines(_lines(spark, sf)).select("line_id", "reason", "n_fields")


def q_slim_packets(spark, sf):
    ok = S.parse_packet_lines(_lines(spark, sf)).where(F.col("kind") == "ok")
    return clean.slim_packets(ok).select("line_id", "timestamp", "src_ip", "pkt_len")


def q_clean_packets(spark, sf):
    return _clean_packets(spark, sf).select("line_id", X.to_ntz("timestamp").alias("timestamp"),
                                            "src_ip", "pkt_len")


def q_filter_since(spark, sf):
    out = clean.filter_since(_clean_packets(spark, sf), HWM)
    return out.select("line_id", X.to_ntz("timestamp").alias("timestamp"), "src_ip", "pkt_len")


def q_filter_destination(spark, sf):
    out = clean.filter_destination(_packets(spark, sf), V.PACKET_DST, 80)
    return out.select("line_id", "src_ip", "dst_ip", "dst_port", "length")


def q_union_logs(spark, sf):
    a = _access(spark, sf).select(F.col("request_id").alias("record_id"), "timestamp", "client_ip",
                                  "http_body_length", "path", F.lit("access").alias("source"))
    p = _clean_packets(spark, sf).select(F.col("line_id").alias("record_id"), "timestamp",
                                         F.col("src_ip").alias("client_ip"), "pkt_len",
                                         F.lit("packet").alias("source"))
    u = S.union_logs([a, p])
    return u.select("record_id", "source", X.to_ntz("timestamp").alias("timestamp"), "client_ip",
                    _round("http_body_length", 4), "path", "pkt_len")


# ---- scalar functions ------------------------------------------------------

def q_tcp_flags_string(spark, sf):
    e = V.table(spark, sf, "events")
    mask = F.pmod(F.col("event_id"), F.lit(256))
    return e.select("event_id", mask.alias("mask"), X.tcp_flags_string(mask).alias("flags"))


def q_ipv4_to_string(spark, sf):
    e = V.table(spark, sf, "events")
    ip = F.pmod(F.col("user_id") * F.lit(2654435761) + F.col("event_id"), F.lit(4294967296))
    return e.select("event_id", ip.alias("ip_int"), X.ipv4_to_string(ip).alias("ip"))


def q_format_packet_ts(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", X.format_packet_ts(F.col("ts").cast("timestamp")).alias("ts_text"))


def q_normalize_flow_fields(spark, sf):
    out = clean.normalize_flow_fields(V.decoded_packets(spark, sf), flag_mask_col="flag_mask")
    return out.select("packet_id", "proto", "src_port", "dst_port", "flags")


def q_ipv4_flow_fields(spark, sf):
    """Flow fields of IPv4 packets with a whole header only."""
    out = clean.normalize_flow_fields(V.decoded_packets(spark, sf), flag_mask_col="flag_mask",
                                      ip_version_col="ip_version", ihl_col="ihl")
    return out.select("packet_id", "proto", "src_port", "dst_port", "flags")


# ---- packet-path RFM, ranks, scores ----------------------------------------

def q_traffic_totals(spark, sf):
    return rfm.traffic_totals(_packets(spark, sf), "src_ip")


def _raw(spark, sf, since=None, until=None, now=V.EVENTS_NOW):
    logs = _clean_packets(spark, sf, since=since)
    if until is not None:
        logs = logs.where(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return rfm.rfm_raw_packets(logs, now)


def q_rfm_raw_packets(spark, sf):
    r = _raw(spark, sf)
    return r.select("src_ip", X.to_ntz("last_seen").alias("last_seen"), "frequency_raw", "monetary_raw",
                    "recency_raw")


_RANKS = {"r_rank": "recency_raw", "f_rank": "frequency_raw", "m_rank": "monetary_raw"}


def q_percent_ranks(spark, sf):
    out = ranks.add_percent_ranks(_raw(spark, sf), _RANKS, key="src_ip")
    return out.select("src_ip", *[_round(c, 9) for c in _RANKS])


def q_percent_ranks_histogram(spark, sf):
    """Few buckets, and rows told apart by number instead of by their key."""
    out = ranks.add_percent_ranks(_raw(spark, sf), _RANKS, n_buckets=4)
    return out.select("src_ip", *[_round(c, 9) for c in _RANKS])


def q_score_rfm(spark, sf):
    return score.score_rfm(_raw(spark, sf), last_updated=V.EVENTS_NOW)


def q_flag_by_composite(spark, sf):
    return score.flag_by_composite(score.score_rfm(_raw(spark, sf), last_updated=V.EVENTS_NOW))


def q_incremental_scores(spark, sf):
    return score.score_rfm(_raw(spark, sf, since=HWM), last_updated=V.EVENTS_NOW)


def q_merge_scores(spark, sf):
    old = score.score_rfm(_raw(spark, sf, until=HWM, now=HWM), last_updated=HWM)
    # some clients aren't seen again: their old rows stay
    again = _raw(spark, sf, since=HWM).where(F.pmod(V.last_octet("src_ip"), F.lit(5)) != 0)
    return score.merge_scores(old, score.score_rfm(again, last_updated=V.EVENTS_NOW))


# ---- logs written to files and read back ------------------------------------

def _folder(spark, name):
    from trafficscore.streaming.runner import scratch_paths
    return scratch_paths(spark, name)[0]


def q_read_access_log_mixed(spark, sf):
    """Three dialects of access log in one folder: all columns, without length
    and in another order, without path."""
    folder = _folder(spark, "access_mixed")
    a = V.access_log(spark, sf).withColumn("http_body_length", F.col("http_body_length").cast("string"))
    a = a.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    for k, columns in enumerate((["timestamp", "client_ip", "path", "http_body_length", "request_id"],
                                 ["request_id", "path", "client_ip", "timestamp"],
                                 ["http_body_length", "client_ip", "timestamp", "request_id"])):
        part = a.where(F.pmod(F.col("request_id"), F.lit(3)) == k).select(*columns)
        part.write.mode("append").option("header", "true").csv(folder)
    back = clean.conform_access_log(S.read_access_log(
        spark, folder, columns=("request_id", "timestamp", "client_ip", "http_body_length", "path")))
    return back.select(F.col("request_id").cast("long").alias("request_id"), X.to_ntz("timestamp").alias("timestamp"),
                       "client_ip", "http_body_length", "path")


def q_read_packet_csv_mixed(spark, sf):
    """Packet logs in two column orders beside an access log in the same folder."""
    folder = _folder(spark, "packet_mixed")
    ok = S.parse_packet_lines(_lines(spark, sf)).where(F.col("kind") == "ok")
    slim = clean.slim_packets(ok)
    for k, columns in enumerate((["timestamp", "src_ip", "pkt_len"], ["pkt_len", "timestamp", "src_ip"])):
        part = slim.where(F.pmod(F.col("line_id"), F.lit(2)) == k).select(*columns)
        part.write.mode("append").option("header", "true").csv(folder)
    (V.access_log_text(spark, sf).select("timestamp", "client_ip", "src_port", "http_body_length")
     .write.mode("append").option("header", "true").csv(folder))
    back = clean.clean_packets(S.read_packet_csv(spark, folder))
    return (back.groupBy(X.to_ntz("timestamp").alias("timestamp"), "src_ip", "pkt_len")
            .agg(F.count(F.lit(1)).alias("n")))


def q_refresh_rfm_job(spark, sf):
    """The refresh job over access-log files, its table read back."""
    from trafficscore.plans.jobs import refresh_rfm
    logs, out = _folder(spark, "refresh_logs"), _folder(spark, "refresh_out")
    a = V.access_log(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    a.drop("request_id").write.option("header", "true").csv(logs)
    refresh_rfm(spark, logs, out, now=dt.datetime.fromisoformat(V.EVENTS_NOW))
    back = S.read_rfm_table(spark, out)
    return back.select("client_ip", _round("recency_days", 9), "frequency", _round("monetary", 4))


def q_run_incremental_job(spark, sf):
    """Converter output, the incremental job with an unset mark, its snapshot read back."""
    from trafficscore.plans.jobs import run_incremental
    from trafficscore.sources.sinks import sink_rotating_csv
    logs, out = _folder(spark, "incremental_logs"), _folder(spark, "incremental_out")
    ok = S.parse_packet_lines(_lines(spark, sf)).where(F.col("kind") == "ok")
    slim = clean.slim_packets(ok).select("timestamp", "src_ip", "pkt_len")
    sink_rotating_csv(slim.withColumn("at", X.parse_timestamp("timestamp")), logs, ts_col="at")
    now = dt.datetime.fromisoformat(V.EVENTS_NOW)
    path = run_incremental(spark, f"{logs}/*.csv", out, f"{out}-mark", now=now)
    back = spark.read.option("header", "true").schema(SCORES_SCHEMA).csv(path)
    return back.withColumn("last_updated", F.regexp_replace("last_updated", "T", " "))


def q_run_merged_job(spark, sf):
    """The merged job over three landings: rows up to the mark but for a tenth, then that tenth (stamped
    before the first run, landed after it) with the rest, then nothing.  The last snapshot's scores are over all rows."""
    from trafficscore.plans.jobs import run_merged
    from trafficscore.sources.sinks import sink_rotating_csv
    logs, out = _folder(spark, "merged_logs"), _folder(spark, "merged_out")
    ok = S.parse_packet_lines(_lines(spark, sf)).where(F.col("kind") == "ok")
    slim = clean.slim_packets(ok).withColumn("at", X.parse_timestamp("timestamp"))
    first = (F.col("at") <= F.lit(HWM).cast("timestamp")) & (F.pmod(F.col("line_id"), F.lit(10)) != 3)
    path = None
    for part, now in ((slim.where(first), HWM), (slim.where(~F.coalesce(first, F.lit(False))), V.EVENTS_NOW), (None, V.EVENTS_NOW)):
        if part is not None:
            # a few files a landing, not one per hour of the log
            sink_rotating_csv(part.select("timestamp", "src_ip", "pkt_len", "at"), logs, ts_col="at", rotate_seconds=10 * 86_400)
        path = run_merged(spark, logs, out, f"{out}-state", now=dt.datetime.fromisoformat(now)) or path
    back = spark.read.option("header", "true").schema(SCORES_SCHEMA).csv(path)
    return back.withColumn("last_updated", F.regexp_replace("last_updated", "T", " "))


# ---- streaming forms (drained with availableNow, compared with batch) ------

def q_stream_packet_tsv(spark, sf):
    from trafficscore.streaming.packets import stream_packet_tsv
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "packet_tsv")
    lines = V.packet_lines_from(V.stream_table(spark, sf, "events"))
    drain(stream_packet_tsv(lines, out, ck, trigger={"availableNow": True}, keep_cols=("line_id",)))
    return (spark.read.schema("line_id long, timestamp string, src_ip string, pkt_len string, rotation string")
            .option("header", "true").csv(out).select("line_id", "timestamp", "src_ip", "pkt_len"))


CAPTURE_FILES = 4


def _write_capture(lines, folder, cut):
    """Capture logs (``CAPTURE_FILES`` of them) as they stand after landings 0 .. of ``lines``: each
    written anew beside its name and put in its place, so a task that runs twice does no harm.  ``cut``:
    the last line isn't finished yet."""
    def write(rows):
        from trafficscore.sources.tail import open_filesystem
        system, base = open_filesystem(folder)
        system.create_dir(base, recursive=True)
        name, out = None, None

        def close():
            if out is not None:
                out.write(b"" if cut else b"\n")
                out.close()
                system.move(f"{base}/_{name}", f"{base}/{name}")

        for row in rows:
            if f"capture-{row.file}.tsv" != name:
                close()
                name = f"capture-{row.file}.tsv"
                out = system.open_output_stream(f"{base}/_{name}")
            else:
                out.write(b"\n")
            out.write(row.value.encode())
        close()

    (lines.withColumn("file", F.pmod(F.hash("line_id"), F.lit(CAPTURE_FILES))).repartition("file")
     .sortWithinPartitions("file", "landing", "line_id").foreachPartition(write))


def q_stream_packet_tail(spark, sf):
    """The converter over growing capture logs, started anew after each of four landings: lines that stand
    there at the first start aren't read, the last line of the second landing is finished by the third,
    the fourth adds nothing."""
    from trafficscore.sources.tail import tail_lines
    from trafficscore.streaming.packets import stream_packet_tsv
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "packet_tail")
    logs = _folder(spark, "capture")
    lines = _lines(spark, sf).withColumn("landing", F.pmod(F.col("line_id"), F.lit(3)))
    for k in range(4):
        if k < 3:
            _write_capture(lines.where(F.col("landing") <= k), logs, cut=k == 1)
        drain(stream_packet_tsv(tail_lines(spark, logs), out, ck, trigger={"availableNow": True}))
    back = (spark.read.schema("timestamp string, src_ip string, pkt_len string, rotation string")
            .option("header", "true").csv(out))
    return back.groupBy("timestamp", "src_ip", "pkt_len").agg(F.count(F.lit(1)).alias("n"))


def q_stream_rfm_raw(spark, sf):
    from trafficscore.streaming.rfm import stream_rfm_raw, write_rfm_stream
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "rfm_raw")
    logs = clean.exclude_static(V.access_log_from(V.stream_table(spark, sf, "events")))
    drain(write_rfm_stream(stream_rfm_raw(logs), out, ck, now=V.EVENTS_NOW, trigger={"availableNow": True}))
    r = spark.read.parquet(out)
    return r.select("client_ip", _round("recency_days", 9), "frequency", _round("monetary", 4))


def q_stream_rfm_upsert(spark, sf):
    """The running table kept by upserts: a few events, then all others, with a restart between; the newest version."""
    from trafficscore.sources.versions import VersionedTable
    from trafficscore.streaming.rfm import read_rfm_versions, stream_rfm_raw, upsert_rfm_stream
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "rfm_upsert")
    landed, _ = scratch_paths(spark, "rfm_landed")
    events = V.table(spark, sf, "events")
    few = F.pmod(F.col("event_id"), F.lit(50)) == 7
    for part in (events.where(~few), events.where(few)):
        part.write.mode("append").parquet(landed)
        logs = clean.exclude_static(V.access_log_from(spark.readStream.schema(events.schema).parquet(landed)))
        drain(upsert_rfm_stream(stream_rfm_raw(logs), out, ck, trigger={"availableNow": True}, n_buckets=16))
    r = read_rfm_versions(VersionedTable(spark, out, "client_ip"), V.EVENTS_NOW)
    return r.select("client_ip", _round("recency_days", 9), "frequency", _round("monetary", 4))


def q_rate_limit_slices(spark, sf):
    """Whether each network's requests stand in slices of about ``hot_rows`` at most, and its over-limit requests."""
    from trafficscore.operators.ratelimit import slice_sizes
    acc = V.access_log(spark, sf).withColumn(
        "subnet", F.concat(F.regexp_extract("client_ip", r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))
    sizes = slice_sizes(acc, "subnet", window_seconds=SUBNET_WINDOW_S, hot_rows=2_000)
    spread = sizes.groupBy("subnet").agg(F.sum("rows").alias("requests"), (F.max("rows") <= 3_000).alias("sliced"))
    over = q_rate_limit_subnet(spark, sf).groupBy("subnet").agg(F.sum(F.col("over_limit").cast("long")).alias("over"))
    return spread.join(over, "subnet")


def _events_with_flush(spark, sf):
    """Events as a stream plus one derived far-future row (event id -1) that
    moves the watermark past every real event when the stream is drained."""
    from trafficscore.streaming.runner import scratch_paths
    flush_dir, _ = scratch_paths(spark, "flush")
    ev = V.table(spark, sf, "events")
    (ev.agg(F.max("ts").alias("m"))
     .select(F.lit(-1).cast("long").alias("event_id"), (F.col("m") + F.expr("INTERVAL 3650 DAYS")).alias("ts"),
             F.lit(-1).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
             F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
     .write.parquet(flush_dir))
    schema = ev.schema
    flush = spark.readStream.schema(schema).parquet(flush_dir)
    return V.stream_table(spark, sf, "events").unionByName(flush)


STREAM_GROUPS = 4096


def _limited_stream(spark, sf, protected_only=False):
    from trafficscore.streaming.ratelimit import rate_limit_stream
    acc = V.access_log_from(_events_with_flush(spark, sf))
    if protected_only:
        acc = clean.protected_requests(acc)
    return rate_limit_stream(acc, tie_col="request_id", window_seconds=LIMIT_WINDOW_S, limit=LIMIT_N,
                             mode="event_time", delay="1 day", groups=STREAM_GROUPS)


def q_stream_rate_limit(spark, sf):
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "rate_limit")
    q = (_limited_stream(spark, sf).writeStream.format("parquet").option("checkpointLocation", ck)
         .trigger(availableNow=True).start(out))
    drain(q)
    r = spark.read.parquet(out).where(F.col("request_id") >= 0)
    return r.select("request_id", "client_ip", X.to_ntz("window_start").alias("window_start"),
                    "request_count", "over_limit")


def q_stream_rate_limit_arrival(spark, sf):
    """The limiter in arrival mode: requests landed in four parts in time order, the query
    run after each from where it stopped, so windows go on over its restarts."""
    from trafficscore.streaming.ratelimit import limiter_state, rate_limit_stream
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "rate_limit_arrival")
    landed, _ = scratch_paths(spark, "arrivals")
    log = V.access_log(spark, sf).select("request_id", "timestamp", "client_ip")
    span = log.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    step = (span["b"] - span["a"]) / 4
    for k in range(4):
        part = log.where(F.col("timestamp") >= F.lit(span["a"] + k * step)) if k else log
        part = part.where(F.col("timestamp") < F.lit(span["a"] + (k + 1) * step)) if k < 3 else part
        part.write.mode("append").parquet(landed)
        limited = rate_limit_stream(spark.readStream.schema(log.schema).parquet(landed), tie_col="request_id",
                                    window_seconds=LIMIT_WINDOW_S, limit=LIMIT_N)
        with limiter_state(spark, drained=True):
            query = (limited.writeStream.format("parquet").option("checkpointLocation", ck)
                     .trigger(availableNow=True).start(out))
        drain(query)
    return spark.read.parquet(out).select("request_id", "client_ip", X.to_ntz("window_start").alias("window_start"),
                                          "request_count", "over_limit")


def q_stream_decide(spark, sf):
    from trafficscore.streaming.decide import decide_stream
    from trafficscore.streaming.runner import drain, scratch_paths
    out, ck = scratch_paths(spark, "decide")
    drain(decide_stream(_limited_stream(spark, sf, protected_only=True), lambda: _lookup_table(spark, sf),
                        out, ck, verdict_kw=VERDICT_KW, trigger={"availableNow": True}))
    r = spark.read.parquet(out).where(F.col("request_id") >= 0)
    return r.select("request_id", "client_ip", "request_count", "over_limit", "suspicious", "decision")


QUERIES = {
    "compute_rfm": q_compute_rfm,
    "compute_rfm_no_monetary": q_compute_rfm_no_monetary,
    "customer_rfm": q_customer_rfm,
    "classify_clients": q_classify_clients,
    "exclude_static": q_exclude_static,
    "average_percentile": q_average_percentile,
    "suspicion_verdict": q_suspicion_verdict,
    "lookup_rfm": q_lookup_rfm,
    "lookup_bucketed": q_lookup_bucketed,
    "lookup_point": q_lookup_point,
    "rate_limit": q_rate_limit,
    "rate_limit_subnet": q_rate_limit_subnet,
    "rate_limit_slices": q_rate_limit_slices,
    "decide_requests": q_decide_requests,
    "conform_access_log": q_conform_access_log,
    "parse_timestamp": q_parse_timestamp,
    "packet_tsv_parse": q_packet_tsv_parse,
    "packet_rejects": q_packet_rejects,
    "slim_packets": q_slim_packets,
    "clean_packets": q_clean_packets,
    "filter_since": q_filter_since,
    "filter_destination": q_filter_destination,
    "union_logs": q_union_logs,
    "tcp_flags_string": q_tcp_flags_string,
    "ipv4_to_string": q_ipv4_to_string,
    "format_packet_ts": q_format_packet_ts,
    "normalize_flow_fields": q_normalize_flow_fields,
    "traffic_totals": q_traffic_totals,
    "rfm_raw_packets": q_rfm_raw_packets,
    "percent_ranks": q_percent_ranks,
    "percent_ranks_histogram": q_percent_ranks_histogram,
    "score_rfm": q_score_rfm,
    "flag_by_composite": q_flag_by_composite,
    "incremental_scores": q_incremental_scores,
    "merge_scores": q_merge_scores,
    "decide_unverified": q_decide_unverified,
    "parse_timestamp_strict": q_parse_timestamp_strict,
    "ipv4_flow_fields": q_ipv4_flow_fields,
    "read_access_log_mixed": q_read_access_log_mixed,
    "read_packet_csv_mixed": q_read_packet_csv_mixed,
    "refresh_rfm_job": q_refresh_rfm_job,
    "run_incremental_job": q_run_incremental_job,
    "run_merged_job": q_run_merged_job,
    "stream_packet_tsv": q_stream_packet_tsv,
    "stream_packet_tail": q_stream_packet_tail,
    "stream_rfm_raw": q_stream_rfm_raw,
    "stream_rfm_upsert": q_stream_rfm_upsert,
    "stream_rate_limit": q_stream_rate_limit,
    "stream_rate_limit_arrival": q_stream_rate_limit_arrival,
    "stream_decide": q_stream_decide,
}
