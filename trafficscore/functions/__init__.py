"""Column expressions (all built-in Spark functions, JVM side)."""

from trafficscore.functions.scalars import (epoch_micros, format_packet_ts, ipv4_to_string,
                                            nan_to_null, parse_timestamp, score_column,
                                            strip_whitespace, tcp_flags_string, to_ntz)

__all__ = ["epoch_micros", "format_packet_ts", "ipv4_to_string", "nan_to_null",
           "parse_timestamp", "score_column", "strip_whitespace", "tcp_flags_string", "to_ntz"]
