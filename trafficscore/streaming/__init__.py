"""Structured Streaming forms of the operators.

File sources (text / CSV / Parquet folders) read files that land whole, ``sources.tail``
logs that grow; checkpoints hold the offsets and the state, so a restarted
or re-scheduled query resumes exactly where it stopped.
"""

from trafficscore.streaming.decide import decide_stream
from trafficscore.streaming.packets import (read_packet_tsv_stream, stream_access_log, stream_land_logs,
                                             stream_packet_tsv)
from trafficscore.streaming.ratelimit import limiter_state, rate_limit_stream, rows_dropped_by_watermark
from trafficscore.streaming.rfm import read_rfm_versions, stream_rfm_raw, upsert_rfm_stream, write_rfm_stream

__all__ = ["decide_stream", "read_packet_tsv_stream", "stream_access_log", "stream_land_logs", "stream_packet_tsv", "limiter_state", "rate_limit_stream", "rows_dropped_by_watermark",
           "stream_rfm_raw", "write_rfm_stream", "upsert_rfm_stream", "read_rfm_versions"]
