"""The decision service's lookup table laid out for lookups.

``save_bucketed`` writes a table dealt into buckets by the client key, each sorted by it, with
Parquet bloom filters on it: a point read opens one bucket, and a join of requests that were landed
in as many buckets shuffles neither side.  A refresh writes a table of a new name, so readers of the
old one are never disturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.operators.rules import UNKNOWN, known_side, unknown_as_sentinel

MEASURES = ("recency_days", "frequency", "monetary")
#: A client with more requests than an average bucket, and than this, is hot.
MIN_HOT_ROWS = 1_000_000


def save_bucketed(df: DataFrame, name: str, path: str, key_col: str = "client_ip", n_buckets: int = 200,
                  expected_keys: int | None = None) -> DataFrame:
    """Write ``df`` as table ``name`` under ``path`` (shared storage): ``n_buckets`` buckets by
    ``key_col``, one file each.  ``expected_keys`` (per file) sizes the bloom filters."""
    w = (df.repartition(n_buckets, key_col).write.format("parquet").mode("errorifexists").option("path", path)
         .option(f"parquet.bloom.filter.enabled#{key_col}", "true").bucketBy(n_buckets, key_col).sortBy(key_col))
    if expected_keys:
        w = w.option(f"parquet.bloom.filter.expected.ndv#{key_col}", str(expected_keys))
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def hot_clients(requests: DataFrame, n_buckets: int, key_col: str = "client_ip",
                min_hot_rows: int = MIN_HOT_ROWS) -> list:
    """Clients with more rows than an average bucket: fewer than ``n_buckets``.  Over a table
    bucketed by the client the counts need no shuffle."""
    counts = requests.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.count(F.lit(1)).alias("_n"))
    total = requests.select(F.count(F.lit(1)).alias("n")).first()["n"]
    hot = counts.where(F.col("_n") > max(total / n_buckets, min_hot_rows))
    return [row[key_col] for row in hot.select(key_col).collect()]


def lookup_bucketed(requests: DataFrame, table: DataFrame, n_buckets: int, key_col: str = "client_ip",
                    min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``lookup_rfm`` over tables of ``save_bucketed`` with the same ``n_buckets``.

    Most clients are joined bucket by bucket.  A bucket can't be split, so hot clients, whose rows
    would fill one, and requests without a client are read in splits of any size: the former with
    the hot clients' rows of the table broadcast (fewer than ``n_buckets``), the latter unmatched.
    """
    key, side = F.col(key_col), known_side(table, key_col)
    hot = hot_clients(requests, n_buckets, key_col, min_hot_rows)
    few = requests.where(key.isNotNull() & ~key.isin(hot)) if hot else requests.where(key.isNotNull())
    out = unknown_as_sentinel(few.join(side.hint("merge"), on=[key_col], how="left"))
    if hot:
        many = requests.where(key.isin(hot)).join(F.broadcast(side.where(key.isin(hot))), on=[key_col], how="left")
        out = out.unionByName(unknown_as_sentinel(many))
    none = requests.where(key.isNull()).withColumns({c: F.lit(float(UNKNOWN)) for c in MEASURES})
    return out.unionByName(none)
