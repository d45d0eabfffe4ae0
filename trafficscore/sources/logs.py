"""Log and table sources.

All readers are lazy ``DataFrameReader`` scans with explicit schemas: no
schema inference (it costs a pass over the data and is unavailable in
streaming), and columns are typed later with ``try_*`` casts so a dirty row
becomes NULL rather than a failed job.
"""

from __future__ import annotations

import csv
import logging
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trafficscore.functions.scalars import PACKET_TS_PATTERN, parse_timestamp, strip_whitespace, whole_number
from trafficscore.schemas import ACCESS_LOG_COLUMNS, PACKET_TSV_COLUMNS, RFM_RAW_SCHEMA, SLIM_PACKET_COLUMNS

log = logging.getLogger(__name__)

# Options shared by every CSV log scan.  An unreadable file fails the scan.
CSV_LOG_OPTIONS = {"header": "true", "mode": "PERMISSIVE"}

# Fixed value: folders that the rotating sinks write below the log folder.
ROTATION_FOLDERS = "rotation=*"


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail fast (driver side, no job) when required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing required columns {missing}; found {df.columns}")
    return df


def union_logs(frames) -> DataFrame:
    """Bag union aligned by column name; a column absent from a part is NULL."""
    frames = list(frames)
    if not frames:
        raise ValueError("union_logs needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_logs(spark: SparkSession, path, fmt: str = "csv", schema=None, **options) -> DataFrame:
    """Format-parameterised scan (csv, json, parquet, orc, text ...).

    CSV gets a header and the options of the log scans; a schema is
    applied when given (needed for CSV/JSON streams, optional otherwise).
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_LOG_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def list_log_files(spark: SparkSession, path) -> list[str]:
    """Data files under files, folders or globs, by the path's own file system.
    A glob ``folder/*.csv`` also takes the files of rotation folders below."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []

    def add(status) -> None:
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            return
        if status.isDirectory():
            own = status.getPath().getFileSystem(conf)
            for child in own.listStatus(status.getPath()):
                add(child)
        elif status.getLen():
            found.append(status.getPath().toString())

    for one in [path] if isinstance(path, str) else list(path):
        folder, _, last = one.rpartition("/")
        globs = [one, f"{folder or '.'}/{ROTATION_FOLDERS}/{last}"] if last.startswith("*.") else [one]
        known = False
        for glob in globs:
            place = jvm.org.apache.hadoop.fs.Path(glob)
            matched = place.getFileSystem(conf).globStatus(place)
            known = known or bool(matched)
            for status in matched or []:
                add(status)
        if not known:
            raise FileNotFoundError(f"no log files at {one!r}")
    return sorted(set(found))


def file_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a CSV file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        plain = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine() or ""
    finally:
        stream.close()
    return tuple(c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]), []))


def read_csv_by_name(spark: SparkSession, path, columns, required, skip_unreadable: bool = False,
                     options: dict | None = None) -> DataFrame:
    """CSV files with possibly different headers, aligned by column name.

    Files are grouped by their header line (only first lines are read here),
    each group is scanned with its own header as schema, checked against the
    file, and the groups are united by name.  All columns are text.  Of ``columns``, those
    that any file has are returned; a column that a file lacks is NULL in its
    rows.  A file that has none of ``required`` (or an unnamed header) is an error: it is
    no such log.  ``skip_unreadable`` leaves out files whose header can't be
    read, with an error log line for each, and skips corrupt blocks.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for one in list_log_files(spark, path):
        try:
            groups.setdefault(file_header(spark, one), []).append(one)
        except Exception:
            if not skip_unreadable:
                raise
            log.exception("unreadable log file skipped: %s", one)
    frames, columns = [], list(columns)
    for header, files in groups.items():
        if not set(header) & set(required):
            raise ValueError(f"{files[0]} is no such log: its columns are {list(header)}, expected some of {list(required)}")
        reader = spark.read.options(**CSV_LOG_OPTIONS, **(options or {}), enforceSchema="false")
        if skip_unreadable:
            reader = reader.option("ignoreCorruptFiles", "true")
        schema = StructType([StructField(c, StringType()) for c in header])
        frames.append(reader.schema(schema).csv(files).select(*[F.col(f"`{c}`") for c in columns if c in header]))
    if not frames:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    out = union_logs(frames)
    return out.select(*[c for c in columns if c in out.columns])


def read_access_log(spark: SparkSession, path, columns=tuple(ACCESS_LOG_COLUMNS), required=("timestamp", "client_ip"),
                    skip_unreadable: bool = False) -> DataFrame:
    """Web access log CSV (a file, a directory or a glob; every file is read),
    aligned by column name.

    Columns stay text here; ``operators.clean.conform_access_log`` types them.
    A measure that no file has is left out, so RFM does without it.
    """
    return read_csv_by_name(spark, path, columns, required, skip_unreadable)


def read_packet_csv(spark: SparkSession, path, columns=tuple(SLIM_PACKET_COLUMNS),
                    required=("timestamp", "src_ip", "pkt_len")) -> DataFrame:
    """Slim packet CSV ``timestamp,src_ip,pkt_len`` (text; typed by
    ``clean_packets``), aligned by column name; other logs in the folder give
    rows without address or length, which cleaning drops."""
    out = read_csv_by_name(spark, path, columns, required)
    absent = {c: F.lit(None).cast("string") for c in columns if c not in out.columns}
    return out.withColumns(absent).select(*columns) if absent else out


def parse_packet_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Classify and split packet-log TSV lines.

    Adds ``line`` (whitespace-stripped), ``kind`` and the eight raw fields.
    ``kind`` is ``skip`` for blank, ``#`` and header lines, ``malformed`` when
    the stripped line does not have exactly 8 tab-separated fields (a trailing
    empty field is lost by the strip, so such a line is malformed too),
    ``missing`` when timestamp, source address or length is empty, else ``ok``.

    The split is produced by a one-row ``inline`` so that it is evaluated
    once per line: a later ``where(kind == ...)`` is not pushed below the
    generator, whereas through a plain projection Catalyst would inline the
    split into every reference of the filter.
    """
    keep = [c for c in lines.columns if c != line_col]
    parts = F.split(strip_whitespace(F.col(line_col)), "\t", -1)
    split_once = lines.select(*keep, F.inline(F.array(F.struct(parts.alias("_parts")))))
    p = F.col("_parts")
    n, first = F.size(p), p[0]
    # a line starts with '#' or 'Timestamp' exactly when its first field does
    kind = (F.when(((n == 1) & (first == "")) | first.startswith("#") | first.startswith("Timestamp"),
                   F.lit("skip"))
            .when(n != len(PACKET_TSV_COLUMNS), F.lit("malformed"))
            .when((p[0] == "") | (p[1] == "") | (p[6] == ""), F.lit("missing"))
            .otherwise(F.lit("ok")))
    fields = [F.when(n == len(PACKET_TSV_COLUMNS), p[i]).alias(name)
              for i, name in enumerate(PACKET_TSV_COLUMNS)]
    return split_once.select(*keep, F.array_join(p, "\t").alias("line"), kind.alias("kind"), *fields,
                             n.alias("n_fields"))


def read_packet_tsv(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Typed packet records from TSV lines (``spark.read.text`` or ``readStream.text``).

    Keeps ``ok`` lines and types the eight fields; the numeric fields use
    ``try_cast`` and the timestamp the packet pattern, so bad values are NULL.
    """
    p = parse_packet_lines(lines, line_col).where(F.col("kind") == "ok")
    passthrough = [c for c in lines.columns if c != line_col]
    return p.select(
        *passthrough,
        parse_timestamp(F.col("Timestamp"), patterns=(PACKET_TS_PATTERN,)).alias("timestamp"),
        F.col("SrcIP").alias("src_ip"),
        F.col("DstIP").alias("dst_ip"),
        F.col("Proto").try_cast("int").alias("proto"),
        F.col("SrcPort").try_cast("int").alias("src_port"),
        F.col("DstPort").try_cast("int").alias("dst_port"),
        whole_number("Length").alias("length"),
        F.col("Flags").alias("flags"),
    )


def rejected_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Lines the converter would log and drop, with the reason.

    The reference only logs them; here they are a DataFrame so a job can
    count or store them (e.g. with ``observe`` or a side sink).
    """
    p = parse_packet_lines(lines, line_col).where(F.col("kind").isin("malformed", "missing"))
    passthrough = [c for c in lines.columns if c != line_col]
    return p.select(*passthrough, "line", F.col("kind").alias("reason"), "n_fields")


def read_rfm_table(spark: SparkSession, path, fmt: str = "csv", schema=RFM_RAW_SCHEMA) -> DataFrame:
    """Raw RFM table (client_ip, recency_days, frequency, monetary)."""
    return read_logs(spark, path, fmt=fmt, schema=schema if fmt in ("csv", "json") else None)


def jdbc_options(env=None, table: str = "rfm_scores") -> dict:
    """Options for ``format("jdbc")`` from the database environment variables.

    Fixed values: the variable names and defaults of the deployment.
    """
    env = os.environ if env is None else env
    host = env.get("POSTGRES_HOST", "db")
    port = env.get("POSTGRES_PORT", "5432")
    db = env.get("POSTGRES_DB", "mydatabase")
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{db}",
        "user": env.get("POSTGRES_USER", "user"),
        "password": env.get("POSTGRES_PASSWORD", "password"),
        "driver": "org.postgresql.Driver",
        "dbtable": table,
    }


def read_scores_jdbc(spark: SparkSession, options: dict | None = None, ip: str | None = None) -> DataFrame:
    """Scored table from the database; a point lookup pushes ``src_ip = ip``
    down into the database query and keeps the first row."""
    df = spark.read.format("jdbc").options(**(options or jdbc_options())).load()
    if ip is not None:
        df = df.where(F.col("src_ip") == F.lit(ip)).limit(1)
    return df
