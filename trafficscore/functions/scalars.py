"""Scalar column expressions.

Everything here is built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; no Python runs per row.  Spark 4 runs in ANSI mode, so
parsing uses the ``try_*`` family and turns bad input into NULL instead of
failing the job (``on_bad="error"`` restores the strict behaviour).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp patterns tried after the default parse, in order.
TIMESTAMP_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")

# TCP flag letters and their bits, most significant first
# (URG 0x20, ACK 0x10, PSH 0x08, RST 0x04, SYN 0x02, FIN 0x01).
TCP_FLAG_BITS = (("U", 0x20), ("A", 0x10), ("P", 0x08), ("R", 0x04), ("S", 0x02), ("F", 0x01))

# Fixed value: text pattern of packet-log timestamps (microseconds).
PACKET_TS_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col, patterns=TIMESTAMP_PATTERNS, on_bad: str = "null") -> Column:
    """First successful parse of a text timestamp.

    The default parse (ISO-8601 with or without fraction, space or ``T``)
    goes first, then ``patterns`` in order.  ``on_bad="null"`` turns
    unparseable text into NULL (the row is dropped by the cleaning step);
    ``on_bad="error"`` fails the query, as a strict parser would.
    """
    c = _c(col)
    parsed = F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(p)) for p in patterns])
    if on_bad == "error":
        return F.when(c.isNotNull() & parsed.isNull(),
                      F.raise_error(F.concat(F.lit("unparseable timestamp: "), c))
                      ).otherwise(parsed)
    if on_bad != "null":
        raise ValueError(f"on_bad must be 'null' or 'error', got {on_bad!r}")
    return parsed


def whole_number(col) -> Column:
    """Text or number -> long, a decimal part cut off; NULL for what is no number."""
    text = _c(col).cast("string")
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))


def epoch_micros(col) -> Column:
    """Microseconds since the epoch for timestamp or timestamp_ntz columns.

    ``timestamp_ntz`` cannot be cast to a number directly; it is first read
    as a session-zone timestamp (UTC in every job).
    """
    return F.unix_micros(_c(col).cast("timestamp"))


def to_ntz(col) -> Column:
    """Wall-clock (zone-free) form of a timestamp, for output tables."""
    return _c(col).cast("timestamp_ntz")


def nan_to_null(col) -> Column:
    """NaN -> NULL.  Spark orders NaN above every number, IEEE/pandas do not;
    carrying missing values as NULL keeps threshold rules NaN-safe."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# Fixed value: the ASCII whitespace set removed around a line.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip_whitespace(col) -> Column:
    """Leading/trailing whitespace removal (tabs and newlines too, not only
    spaces): ``trim`` with an explicit character set, no regex."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def tcp_flags_string(mask) -> Column:
    """TCP flag byte -> six letters ``UAPRSF`` with ``-`` for unset bits."""
    m = _c(mask).cast("int")
    return F.concat(*[F.when((m.bitwiseAND(F.lit(bit))) != 0, F.lit(ch)).otherwise(F.lit("-"))
                      for ch, bit in TCP_FLAG_BITS])


def ipv4_to_string(col) -> Column:
    """Unsigned 32-bit address (as a long) -> dotted quad."""
    v = _c(col).cast("long")
    return F.concat_ws(".", *[(F.shiftright(v, s).bitwiseAND(F.lit(255))).cast("string")
                              for s in (24, 16, 8, 0)])


def format_packet_ts(col) -> Column:
    """Timestamp -> ``yyyy-MM-dd HH:mm:ss.ffffff`` (always six fraction digits)."""
    return F.date_format(_c(col), PACKET_TS_PATTERN)


def score_column(rank_col, higher_is_better: bool, bins: int = 5, min_score: int = 0) -> Column:
    """Percentile rank in [0, 1] -> integer score ``least(bins, ceil(rank*bins))``.

    For recency a lower rank is better, so the rank is inverted first.  The
    lowest rank maps to 0 (quirk Q1); ``min_score=1`` clamps to 1..bins.
    """
    r = _c(rank_col)
    base = r if higher_is_better else (F.lit(1.0) - r)
    score = F.least(F.lit(bins), F.ceil(base * F.lit(float(bins))).cast("int"))
    if min_score:
        score = F.greatest(F.lit(min_score), score)
    return score
