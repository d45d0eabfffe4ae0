"""Readers for the log dialects and the RFM tables; sinks live in ``sinks``."""

from trafficscore.sources.logs import (jdbc_options, parse_packet_lines, read_access_log,
                                       read_logs, read_packet_csv, read_packet_tsv,
                                       read_rfm_table, read_scores_jdbc, rejected_lines,
                                       require_columns, union_logs)
from trafficscore.sources.hwm import load_high_water_mark, save_high_water_mark
from trafficscore.sources.tail import tail_lines

__all__ = ["jdbc_options", "parse_packet_lines", "read_access_log", "read_logs",
           "read_packet_csv", "read_packet_tsv", "read_rfm_table", "read_scores_jdbc",
           "rejected_lines", "require_columns", "union_logs", "load_high_water_mark",
           "save_high_water_mark", "tail_lines"]
