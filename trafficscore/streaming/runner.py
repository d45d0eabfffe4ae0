"""Helpers to run a stream to completion (``availableNow``) in a fresh
folder under the cluster's checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from trafficscore.session import checkpoint_dir


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output path, checkpoint path) for one run, on shared storage."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def drain(query, timeout_s: float | None = None) -> None:
    """Wait for an ``availableNow`` query and re-raise its failure."""
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise query.exception()
