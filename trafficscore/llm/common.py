"""Helpers shared by the corpus operators.

* ``read_table`` - a table of a data folder, by Spark's own reader.
* ``unused`` - a helper column's name that a table doesn't have.
* ``cut`` - reliable checkpoint in the cluster's shared folder.
* ``map_arrow`` - ``mapInArrow`` over a column pruned table, fed in chunks of
  bounded text size.
* ``number_rows`` - gapless row numbers without one big task.
* ``components`` - connected components of a link table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficscore.plans.strategies import materialize

CHUNK_BYTES = 16 << 20      # text a Python worker holds at a time


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so a lost
    executor costs no recomputation of what stands before."""
    return materialize(df, "checkpoint")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``limit`` bytes; one row is never split."""
    for batch in batches:
        n = batch.num_rows
        step = n if batch.nbytes <= limit else max(1, int(n * limit / batch.nbytes))
        for at in range(0, n, max(step, 1)):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None],
              schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``fn`` over Arrow batches of at most about ``limit`` bytes."""

    def run(batches):
        for piece in _pieces(batches, limit):
            out = fn(piece)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(run, schema)


def number_rows(df: DataFrame, by: list[str], key: str, name: str,
                first: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 0-based gapless row numbers within each ``by``, in the
    order of ``first`` (columns with few values), then a hash of ``key``.

    No task sees more than one (by, first, hash bucket) group.  The per-group
    counts are pre-aggregated; their running sums (few values of ``by`` and
    ``first``, times ``parts``) are small and broadcast.  Order inside a
    bucket: ``key``; ``key`` should be unique per row or the tie is free.
    """
    first = first or []
    parts = parts or partitions(df)
    group = [*by, *first, "_bucket"]
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy(*first, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(group)],
                            F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group).orderBy(key)
    same = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(group)]
    return (rows.withColumn("_in", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), on=_all(same), how="inner")
            .withColumn(name, (F.col("_offset") + F.col("_in")).cast("long"))
            .drop("_bucket", "_in", "_offset", *[f"_o{i}" for i in range(len(group))]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long): one row (node,
    component) per node that has a link; ``component`` is the smallest node.

    Each round: every node takes the smallest label among its own, its
    neighbours' and its label's label (pointer jumping), so long chains
    halve.  Minima are pre-aggregated before the shuffle, so a node with very
    many links reaches the reducer as one row per map task.  The label table
    is cut after every round; only a count of changes reaches the driver.
    """
    both = (links.where("a <> b").select("a", "b")
            .unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    for _ in range(rounds):
        heard = (both.join(labels.select(F.col("node").alias("b"), "component"), on="b")
                 .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard")))
        jumped = labels.select(F.col("node").alias("component"), F.col("component").alias("jumped"))
        stepped = (labels.join(heard, on="node", how="left").join(jumped, on="component", how="left")
                   .select("node", F.col("component").alias("was"),
                           F.least("component", "heard", "jumped").alias("component")))
        stepped = cut(stepped)
        # the label's own node hears of the smaller label too (hooking), else chains move one step a round
        hooks = stepped.where("component < was").groupBy(F.col("was").alias("node")).agg(F.min("component").alias("hook"))
        if stepped.where("component < was").isEmpty():
            return stepped.select("node", "component")
        labels = cut(stepped.join(hooks, on="node", how="left")
                     .select("node", F.least("component", "hook").alias("component")))
    raise RuntimeError(f"links did not settle within {rounds} rounds")
