"""Job configuration: the settings of the original deployment as parameters.

Defaults are the deployment's; ``from_env`` reads the same environment
variable names.  Jobs take a ``JobConfig`` (or plain arguments), so a
scheduler can run them with per-environment values.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# Environment variable names and their defaults, as deployed.
ENV_DEFAULTS = {
    "NETWORK_LOG_DIR": "network_logs",
    "OUTPUT_FILE": "rfm_scores.csv",
    "INTERVAL_SECONDS": "3600",
    "TIMESTAMP_COLUMN": "timestamp",
    "IP_COLUMN": "client_ip",
    "MONETARY_COLUMN": "http_body_length",
    "DATE_FORMAT": "",
    "LOG_DATA_PATH": "./network_logs/*.csv",
    "RFM_OUTPUT_DIR": "./rfm_outputs",
    "RFM_PATH": "./rfm_scores.csv",
    "RFM_COMPOSITE_THRESHOLD": "400.0",
    "SOURCE_TZ": "",                        # own setting: zone that naive log times were written in
}
# High-water-mark file and score buckets of the incremental job.
LAST_RUN_FILE = "last_run.txt"
RFM_BINS = 5


@dataclass(frozen=True)
class JobConfig:
    network_log_dir: str = ENV_DEFAULTS["NETWORK_LOG_DIR"]       # full refresh input
    output_file: str = ENV_DEFAULTS["OUTPUT_FILE"]               # full refresh output
    interval_seconds: int = int(ENV_DEFAULTS["INTERVAL_SECONDS"])
    ts_col: str = ENV_DEFAULTS["TIMESTAMP_COLUMN"]
    ip_col: str = ENV_DEFAULTS["IP_COLUMN"]
    monetary_col: str | None = ENV_DEFAULTS["MONETARY_COLUMN"]
    date_format: str | None = None                               # accepted, not used (parse is format-free)
    log_data_path: str = ENV_DEFAULTS["LOG_DATA_PATH"]           # incremental input
    rfm_output_dir: str = ENV_DEFAULTS["RFM_OUTPUT_DIR"]         # incremental output
    last_run_file: str = LAST_RUN_FILE
    rfm_bins: int = RFM_BINS
    rfm_path: str = ENV_DEFAULTS["RFM_PATH"]                     # lookup table
    composite_threshold: float = float(ENV_DEFAULTS["RFM_COMPOSITE_THRESHOLD"])
    source_tz: str | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "JobConfig":
        return replace(self, **kw)


def from_env(env=None) -> JobConfig:
    """Configuration from environment variables (unset -> deployment default)."""
    env = os.environ if env is None else env
    g = lambda k: env.get(k, ENV_DEFAULTS[k])
    return JobConfig(
        network_log_dir=g("NETWORK_LOG_DIR"), output_file=g("OUTPUT_FILE"),
        interval_seconds=int(g("INTERVAL_SECONDS")), ts_col=g("TIMESTAMP_COLUMN"), ip_col=g("IP_COLUMN"),
        monetary_col=g("MONETARY_COLUMN") or None, date_format=g("DATE_FORMAT") or None,
        log_data_path=g("LOG_DATA_PATH"), rfm_output_dir=g("RFM_OUTPUT_DIR"), rfm_path=g("RFM_PATH"),
        composite_threshold=float(g("RFM_COMPOSITE_THRESHOLD")), source_tz=g("SOURCE_TZ") or None,
    )
