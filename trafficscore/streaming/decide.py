"""Request decisions over a stream: limiter state + per-batch RFM lookup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficscore.operators.rules import judge_limited
from trafficscore.plans.strategies import materialize, released_after


def judge_batch(limited: DataFrame, table: DataFrame, key_col: str = "client_ip", verdict_kw: dict | None = None,
                unknown_policy: str = "compat") -> DataFrame:
    """Decision for one micro-batch of limiter output (same rules and the
    same one-pass lookup of over-limit rows as in batch)."""
    return judge_limited(limited, table, key_col=key_col, unknown_policy=unknown_policy, verdict_kw=verdict_kw)


def decide_stream(limited: DataFrame, table_loader: Callable[[], DataFrame], output_path: str, checkpoint: str,
                  key_col: str = "client_ip", verdict_kw: dict | None = None, fmt: str = "parquet",
                  trigger: dict | None = None, table_version: Callable[[], object] | None = None) -> StreamingQuery:
    """Start the decision stream.

    ``table_loader`` is called for every micro-batch, so a refreshed RFM table
    is picked up (no stale snapshot); with ``table_version`` (something that
    changes when the table does, e.g. its newest snapshot's name) only when
    the version is a new one, and the table is kept in between.  The
    micro-batch is kept while it is judged, so the limiter runs once.
    Each batch replaces its own ``batch_id`` partition of ``output_path``
    (dynamic partition overwrite), so a batch replayed after a failure does
    not duplicate rows."""
    kept: dict = {}

    def table() -> DataFrame:
        if table_version is None:
            return table_loader()
        version = table_version()
        if "table" not in kept or kept["version"] != version:
            if "table" in kept:
                kept["table"].unpersist()
            kept.update(version=version, table=table_loader().persist())
        return kept["table"]

    def write(batch: DataFrame, batch_id: int) -> None:
        with released_after():      # tables cached for this batch are dropped after it
            (judge_batch(materialize(batch), table(), key_col, verdict_kw).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
             .partitionBy("batch_id").save(output_path))

    return (limited.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())
