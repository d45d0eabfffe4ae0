"""Schemas of the log dialects and of the RFM tables, plus column roles.

Streaming sources need explicit schemas, and a glob over files with different
headers binds columns by position in Spark, so every dialect is read with its
own schema and aligned by name afterwards (see ``sources.logs.union_logs``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (FloatType, IntegerType, LongType, DoubleType,
                               StringType, StructField, StructType)

# Header of the web access log (8 columns, in file order).
ACCESS_LOG_COLUMNS = ["timestamp", "client_ip", "src_port", "method", "path",
                      "http_body_length", "user_agent", "referer"]

# Fields of the packet log TSV written by the capture tool.
PACKET_TSV_COLUMNS = ["Timestamp", "SrcIP", "DstIP", "Proto", "SrcPort",
                      "DstPort", "Length", "Flags"]

# The slim packet CSV (what the converter keeps).
SLIM_PACKET_COLUMNS = ["timestamp", "src_ip", "pkt_len"]

RFM_RAW_SCHEMA = StructType([
    StructField("client_ip", StringType()),
    StructField("recency_days", DoubleType()),
    StructField("frequency", LongType()),
    StructField("monetary", DoubleType()),
])

# Scored table (one row per source address).  Scores are ints internally;
# the relational sink wants floats (see ``sources.sinks.write_scores_jdbc``).
SCORES_SCHEMA = StructType([
    StructField("src_ip", StringType(), nullable=False),
    StructField("r_score", IntegerType(), nullable=False),
    StructField("f_score", IntegerType(), nullable=False),
    StructField("m_score", IntegerType(), nullable=False),
    StructField("composite_score", FloatType()),
    StructField("last_updated", StringType(), nullable=False),
])

# Column types for the JDBC table (primary key src_ip, float scores).
SCORES_JDBC_COLUMN_TYPES = ("src_ip VARCHAR(64), r_score FLOAT, f_score FLOAT, "
                            "m_score FLOAT, composite_score FLOAT, last_updated VARCHAR(64)")


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns carry time, client key and monetary value.

    Defaults are those of the access-log job (the code's, not the docstring's).
    ``monetary_col=None`` means the table has no monetary measure.
    """
    ts_col: str = "timestamp"
    key_col: str = "client_ip"
    monetary_col: str | None = "http_body_length"


ACCESS_ROLES = ColumnRoles()
