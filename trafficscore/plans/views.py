"""Domain views derived from the driver tables.

No driver table is an access log or a packet log, so the jobs read views
that Spark derives from ``events`` and ``orders`` (the same derivation is
written as SQL for the oracle in ``trafficscore.plans.oracle``).  Work grows
with the tables: every view is a projection of all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficscore.functions.scalars import format_packet_ts, tcp_flags_string
from trafficscore.session import ensure_utc

# Fixed reference times of the fixtures (never the wall clock).
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"

# Fixed values of the packet view: destination, malformed-line moduli.
PACKET_DST = "10.255.0.1"
MALFORMED_MOD, COMMENT_MOD, EMPTY_IP_MOD = 97, 89, 83
# ... and of lines whose fields are bad: no time, negative, decimal or no length.
BAD_TIME_MOD, NEGATIVE_MOD, DECIMAL_MOD, NO_NUMBER_MOD = 71, 79, 73, 67


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a file stream (the glob keeps the base path a
    directory while matching only this table's file)."""
    ensure_utc(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{sf_dir}/{name}.parque[t]")


def client_ip(user_id: str = "user_id") -> F.Column:
    """user id column -> ``10.0.<id div 256>.<id mod 256>``."""
    return F.concat(F.lit("10.0."), F.expr(f"`{user_id}` div 256").cast("string"),
                    F.lit("."), F.pmod(F.col(user_id), F.lit(256)).cast("string"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log view of ``events``: one request per event.

    view/click -> the protected route, error -> a static asset, else ``/``.
    ``http_body_length`` is the event value; ``request_id`` the event id.
    """
    return access_log_from(table(spark, sf_dir, "events"))


def access_log_from(e: DataFrame) -> DataFrame:
    """``access_log`` over any events DataFrame (batch or stream)."""
    path = (F.when(F.col("event_type").isin("view", "click"), F.lit("/sensitive-data"))
            .when(F.col("event_type") == "error", F.lit("/static/x"))
            .otherwise(F.lit("/")))
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        client_ip("user_id").alias("client_ip"),
        (F.lit(1024) + F.pmod(F.col("event_id"), F.lit(60000))).cast("string").alias("src_port"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        path.alias("path"),
        F.col("value").alias("http_body_length"),
        F.lit("").alias("user_agent"),
        F.lit("").alias("referer"),
    )


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet-log TSV lines (column ``value``) derived from ``events``.

    error -> UDP, signup -> ICMP, else TCP; length = value in hundredths;
    some lines are damaged on purpose: ``event_id % 97 == 0`` drops the last
    field, ``% 89`` is a comment line, ``% 83`` has an empty source address,
    ``% 71`` no time, ``% 79`` a negative length, ``% 73`` a decimal one and
    ``% 67`` one that is no number.
    """
    return packet_lines_from(table(spark, sf_dir, "events"))


def packet_lines_from(e: DataFrame) -> DataFrame:
    """``packet_lines`` over any events DataFrame (batch or stream)."""
    eid = F.col("event_id")
    proto = (F.when(F.col("event_type") == "error", F.lit(17))
             .when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(6)))
    has_ports = proto.isin(6, 17)
    src_port = F.when(has_ports, F.lit(1024) + F.pmod(eid, F.lit(60000))).otherwise(F.lit(0))
    dst_port = F.when(proto == 6, F.lit(80)).when(proto == 17, F.lit(53)).otherwise(F.lit(0))
    flags = F.when(proto == 6, tcp_flags_string(F.pmod(eid, F.lit(64)))).otherwise(F.lit("-"))
    src = F.when(F.pmod(eid, F.lit(EMPTY_IP_MOD)) == 0, F.lit("")).otherwise(client_ip("user_id"))
    length = F.round(F.col("value") * 100).cast("long").cast("string")
    length = (F.when(F.pmod(eid, F.lit(NEGATIVE_MOD)) == 0, F.concat(F.lit("-1"), length))
              .when(F.pmod(eid, F.lit(DECIMAL_MOD)) == 0, F.concat(length, F.lit(".75")))
              .when(F.pmod(eid, F.lit(NO_NUMBER_MOD)) == 0, F.lit("n/a")).otherwise(length))
    time = F.when(F.pmod(eid, F.lit(BAD_TIME_MOD)) == 0, F.lit("no-time")).otherwise(
        format_packet_ts(F.col("ts").cast("timestamp")))
    seven = F.concat_ws("\t", time, src, F.lit(PACKET_DST),
                        proto.cast("string"), src_port.cast("string"), dst_port.cast("string"), length)
    line = (F.when(F.pmod(eid, F.lit(COMMENT_MOD)) == 0, F.concat(F.lit("# marker "), eid.cast("string")))
            .when(F.pmod(eid, F.lit(MALFORMED_MOD)) == 0, seven)
            .otherwise(F.concat_ws("\t", seven, flags)))
    return e.select(eid.alias("line_id"), line.alias("value"))


def customer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second RFM domain: customers' orders (key, order time, price in cents)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("client_id"),
                    F.col("o_orderdate").cast("timestamp").alias("timestamp"),
                    F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"))


def last_octet(ip: str = "client_ip") -> F.Column:
    """Last number of a dotted address."""
    return F.element_at(F.split(F.col(ip), r"\."), -1).cast("int")


def access_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log as raw CSV text with dirt: every 101st timestamp is
    not a time, every 103rd length, 107th port and 109th agent are absent, every
    41st length has decimals;
    even ids write ISO ``T`` with microseconds, odd ids whole seconds."""
    a = access_log(spark, sf_dir)
    rid = F.col("request_id")
    ts = (F.when(F.pmod(rid, F.lit(101)) == 0, F.lit("invalid-timestamp"))
          .when(F.pmod(rid, F.lit(2)) == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
          .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))
    return a.select(
        "request_id", ts.alias("timestamp"), "client_ip",
        F.when(F.pmod(rid, F.lit(107)) == 0, F.lit(None)).otherwise(F.col("src_port")).alias("src_port"),
        "method", "path",
        F.when(F.pmod(rid, F.lit(103)) == 0, F.lit(None))
        .when(F.pmod(rid, F.lit(41)) == 0, F.concat(F.pmod(rid, F.lit(1000)).cast("string"), F.lit(".25")))
        .otherwise(F.round(F.col("http_body_length") * 100).cast("long").cast("string")).alias("http_body_length"),
        F.when(F.pmod(rid, F.lit(109)) == 0, F.lit(None)).otherwise(F.lit("agent/1")).alias("user_agent"),
        F.lit(None).cast("string").alias("referer"),
    )


def decoded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packet headers before normalization: raw ports and flag byte
    present for every protocol (error -> UDP, signup -> ICMP, else TCP)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    proto = (F.when(F.col("event_type") == "error", F.lit(17))
             .when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(6)))
    return e.select(eid.alias("packet_id"), proto.alias("proto"),
                    (F.lit(1024) + F.pmod(eid, F.lit(60000))).cast("int").alias("src_port"),
                    F.lit(443).alias("dst_port"), F.pmod(eid, F.lit(64)).cast("int").alias("flag_mask"),
                    F.lit("").alias("flags"),
                    F.when(F.pmod(eid, F.lit(13)) == 0, 6).otherwise(4).alias("ip_version"),
                    F.when(F.pmod(eid, F.lit(17)) == 0, 4).otherwise(5).alias("ihl"))
