"""Join and materialization strategies shared by the operators.

* ``materialize`` - reuse one computed table across several actions, either
  with ``persist`` (recomputed from lineage if an executor is lost) or with a
  reliable ``checkpoint`` in the cluster's shared checkpoint folder.
* ``released_after`` - drop the tables a job or micro-batch cached.
* ``size_checked_join`` - broadcast the small side only after measuring it;
  beyond the bounds, a shuffle join (AQE splits hot keys) that deals rows
  without a key evenly.
"""

from __future__ import annotations

import math
import threading
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType,
                               TimestampType)

from trafficscore.session import checkpoint_dir

# Default bound for broadcasting a counted side (rows).  A lookup row here is
# a few tens of bytes, so 1M rows (~60 MB) stays well below broadcast limits.
BROADCAST_MAX_ROWS = 1_000_000
# ... and in bytes, whatever the rows are like.
BROADCAST_MAX_BYTES = 128 << 20
# Values that rows without a join key are spread over.
SPREAD = 1 << 16

_LOCAL = threading.local()     # per thread: foreachBatch runs on each stream's own thread


def _scopes() -> list:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


@contextmanager
def released_after():
    """Unpersist every table ``materialize`` persisted inside the block.

    Jobs and micro-batches wrap their action in it, so a long-running
    stream does not accumulate cached tables batch after batch.
    """
    scopes = _scopes()
    scopes.append([])
    try:
        yield
    finally:
        for df in scopes.pop():
            df.unpersist()


def materialize(df: DataFrame, how: str = "persist") -> DataFrame:
    """Keep ``df`` for reuse by several actions.

    ``persist``: memory-and-disk cache, lineage kept (lost blocks recompute).
    ``checkpoint``: written to ``spark.checkpoint.dir`` (shared storage),
    lineage cut; survives executor loss without recomputation.
    ``none``: no-op.
    """
    if how == "persist":
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        scopes = _scopes()
        if scopes:
            scopes[-1].append(out)
        return out
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "none":
        return df
    raise ValueError(f"unknown materialize mode {how!r}")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def table_size(df: DataFrame) -> tuple[int, int]:
    """(rows, about how many bytes) of a table, from one aggregation: fixed
    widths of the schema, actual lengths of text and binary columns."""
    fixed, lengths = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            lengths.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
            fixed += 16
        else:
            fixed += 8 if isinstance(f.dataType, (NumericType, TimestampType, TimestampNTZType, DateType, BooleanType)) else 64
    text = F.coalesce(F.sum(sum(lengths, F.lit(0)).cast("long")), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), text.alias("b")).first()
    return int(row["n"]), int(row["n"]) * fixed + int(row["b"])


def size_checked_join(big: DataFrame, small: DataFrame, keys, how: str = "left",
                      broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                      broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
                      size: tuple[int, int] | None = None) -> DataFrame:
    """``big JOIN small USING keys`` where ``small`` has at most one row per key.

    ``small`` is measured first (``size`` may be passed when known).  Within
    both bounds it is broadcast.  Otherwise both sides are shuffled, and AQE
    splits a hot key's partition on the big side.  Rows of ``big`` without a
    key can match nothing; in a left join they get a spread value as one more
    join column, which no row of ``small`` has, so however many they are, they
    are dealt evenly.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if how not in ("left", "inner"):
        raise ValueError("size_checked_join supports 'left' and 'inner'")
    if size is None:
        small = materialize(small)      # measuring fills the cache the join then reads
        size = table_size(small)
    if size[0] <= broadcast_max_rows and size[1] <= broadcast_max_bytes:
        return big.join(F.broadcast(small), on=keys, how=how)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    if how == "inner":
        return big.where(~keyless).join(small, on=keys, how=how)
    spread = F.when(keyless, F.pmod(F.xxhash64(*big.columns), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    # always 0, but no literal: that would be folded away from the join's keys
    zero = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long"))
    return (big.withColumn("_spread", spread)
            .join(small.withColumn("_spread", zero), on=[*keys, "_spread"], how=how)
            .drop("_spread"))


def bucket_text(value: str, bounds: list[float]) -> tuple[str, str]:
    """SQL texts of the number of sorted ``bounds`` <= ``value`` and of whether ``value`` is
    one of them, looked up among every k-th bound and then among k.  Texts, because a
    column object of thousands of literals takes as many calls to build."""
    def array(values):
        return "array(" + ", ".join(f"double('{b!r}')" if not math.isfinite(b) else f"{b!r}D" for b in values) + ")"

    if not bounds:
        return "0", "false"
    if len(bounds) <= 16:
        return f"size(filter({array(bounds)}, _bound_ -> _bound_ <= {value}))", f"array_contains({array(bounds)}, {value})"
    step = math.isqrt(len(bounds))
    fine = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = f"size(filter({array([f[0] for f in fine])}, _bound_ -> _bound_ <= {value}))"
    parts = "array(" + ", ".join(map(array, fine)) + ")"
    at = (f"transform(array({coarse}), _at_ -> CASE WHEN _at_ = 0 THEN 0 ELSE (_at_ - 1) * {step}"
          f" + size(filter({parts}[_at_ - 1], _bound_ -> _bound_ <= {value})) END)[0]")
    return at, f"transform(array({coarse}), _at_ -> _at_ > 0 AND array_contains({parts}[greatest(_at_, 1) - 1], {value}))[0]"
