"""Traffic scoring on Spark.

Recency / frequency / monetary (RFM) measures per client, percentile ranks and
0-5 scores, rule-based labels, an anchored per-client rate limiter and the
request decision built from them -- all as DataFrame plans, batch and
Structured Streaming.
"""

from trafficscore.session import build_session, checkpoint_dir, ensure_utc, ship_package

__all__ = ["build_session", "checkpoint_dir", "ensure_utc", "ship_package"]
