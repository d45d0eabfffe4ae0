"""Global percentile ranks without a single-partition window and without joins on values.

``F.percent_rank().over(Window.orderBy(v))`` has no partition key, so Spark
moves every row into one task.  Here the ranked columns are sorted by sampling, all
of them in the same exchange:

1. one job gives each column's counts and quantiles; the quantiles are the
   bounds of value buckets, as many as the cluster has partitions.  A value that is a bound
   has a bucket of its own, those between two bounds share one;
2. rows are stacked as (column, value), the row itself riding in its first entry,
   and dealt by (column, bucket).  Rows per bucket (pre-aggregated; one line per
   column and bucket, broadcast) give each bucket's offset, a rank inside it
   the rest: ``less(v)`` = rows with a smaller value;
3. a value that many rows share (most clients have frequency 1) fills a bucket of its
   own, whose rows all have the same rank, the offset.  They need not meet, so they
   are dealt over all partitions by a hash;
4. several columns: the entries of a row come back together in one more exchange
   by its key.

There is one path at every size.  ``method="window"`` spells out the plain
window, as the oracle of the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType)

from trafficscore.plans.strategies import bucket_text, materialize, shuffle_partitions

# Whole numbers up to here are told apart as doubles.
EXACT = 1 << 53


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _told_apart(kind: DataType, column: str) -> str:
    """Whether values of that type that are equal as doubles are equal."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, FloatType, DoubleType)):
        return "true"
    return f"({column} > -{EXACT} AND {column} < {EXACT})" if isinstance(kind, LongType) else "false"


class Ranked:
    """Entries of ``columns`` of ``df``, ranked.

    ``entries``: per row and column ``_c`` (the column's number), ``_less`` (rows with a
    smaller value, NULLs being smallest), ``_peers`` (rows with the same value) and ``_row``
    (all of the row's columns in its entry of column 0, else NULL), and the row's ``id`` columns.
    """

    def __init__(self, df: DataFrame, columns: list[str], ids: list[str], n_buckets: int | None = None):
        parts = shuffle_partitions(df)
        cuts = n_buckets or max(parts, 1)
        own = [_quoted(c) for c in columns]
        shares = [i / cuts for i in range(1, max(cuts, 2))]
        stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(own)],
                       *[F.percentile_approx(F.col(c).cast("double"), shares, max(10_000, 4 * cuts)).alias(f"b{i}")
                         for i, c in enumerate(own)]).first()
        self.n = int(stats["n"])
        self.n_null = [self.n - int(stats[f"k{i}"]) for i in range(len(columns))]
        slots = [f"_v{i}" for i in range(len(columns))]
        keys = [f"_id{i}" for i in range(len(ids))]
        whole = ", ".join(_quoted(f.name) for f in df.schema.fields)
        hashed = ", ".join(_quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, MapType))
        spread = f"1 + cast(pmod(xxhash64({hashed}), {parts}) as int)"

        def entry(i: int) -> str:
            value = f"cast({own[i]} as double)"
            bounds = sorted({float(b) for b in stats[f"b{i}"] or [] if b == b})
            at, bound = bucket_text(value, bounds)
            # the value of a bound is alone in its bucket, and so is NaN
            alone = f"(isnan({value}) OR {bound} AND {_told_apart(df.schema[columns[i]].dataType, own[i])})"
            fields = {
                "_c": str(i),
                "_b": f"CASE WHEN {own[i]} IS NULL THEN -1 WHEN isnan({value}) THEN {2 * len(bounds) + 1} ELSE 2 * {at} - CASE WHEN {bound} THEN 1 ELSE 0 END END",
                "_s": f"CASE WHEN {own[i]} IS NULL OR {alone} THEN {spread} ELSE 0 END",
                **{slot: c if i == j else f"CASE WHEN false THEN {c} END" for j, (slot, c) in enumerate(zip(slots, own, strict=True))},
                **dict(zip(keys, map(_quoted, ids), strict=True)),
                "_row": f"struct({whole})" if i == 0 else f"CASE WHEN false THEN struct({whole}) END"}
            return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in fields.items()) + ")"

        stacked = df.selectExpr(f"inline(array({', '.join(map(entry, range(len(columns))))}))")
        # one line per column and bucket: the proven-small side of a broadcast join
        before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (stacked.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_total"))
                   .select("_c", "_b", "_total", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_off")))
        inside = Window.partitionBy("_c", "_b", "_s")
        peers = F.count(F.lit(1)).over(Window.partitionBy("_c", "_b", "_s", *slots))
        self.entries = (stacked.join(F.broadcast(offsets), ["_c", "_b"])
                        .withColumn("_less", F.col("_off") + F.rank().over(inside.orderBy(*slots)) - 1)
                        .withColumn("_peers", F.when(F.col("_s") > 0, F.col("_total")).otherwise(peers)))
        self.keys, self.slots = keys, slots


def add_percent_ranks(df: DataFrame, specs: dict, method: str = "histogram", materialize_input: str = "persist",
                      n_buckets: int | None = None, key: str | None = None) -> DataFrame:
    """Several global percent ranks, e.g. ``{"r_rank": "recency_raw", ...}``:
    ``percent_rank()`` over each column ascending (NULLs first, rank 0), equal
    to Spark's window function for every input.

    ``key``: a column that few rows share (one row per client, say); by it the
    ranks of a row come back together.  Without one, and with several columns,
    rows are numbered on a checkpointed copy."""
    if method == "window":
        for out, v in specs.items():
            df = df.withColumn(out, F.percent_rank().over(Window.orderBy(F.col(v).asc())))
        return df
    if method != "histogram":
        raise ValueError(f"unknown rank method {method!r}")
    columns = list(dict.fromkeys(specs.values()))
    names = df.columns
    if key is None and len(columns) > 1:
        # numbers must not change if a task runs again
        base = materialize(df.withColumn("_rid", F.monotonically_increasing_id()), "checkpoint")
        ids = ["_rid"]
    else:
        base = df if df.is_cached else materialize(df, materialize_input)
        ids = [key, *columns] if len(columns) > 1 else []
    ranked = Ranked(base, columns, ids, n_buckets)
    rank = F.col("_less").cast("double") / F.lit(float(max(ranked.n - 1, 1)))
    if len(columns) == 1:
        return ranked.entries.select(*[F.col("_row")[c].alias(c) for c in names], *[rank.alias(out) for out in specs])
    # rows that share the key and all ranked values share their ranks
    back = ranked.entries.groupBy(*ranked.keys).agg(
        F.collect_list("_row").alias("_rows"), *[F.max(F.when(F.col("_c") == i, rank)).alias(f"_r{i}") for i in range(len(columns))])
    row = back.select(F.explode("_rows").alias("_row"), *[f"_r{i}" for i in range(len(columns))])
    return row.select(*[F.col("_row")[c].alias(c) for c in names],
                      *[F.col(f"_r{columns.index(v)}").alias(out) for out, v in specs.items()])


def percent_rank_column(df: DataFrame, v: str, out: str, method: str = "histogram", **kw) -> DataFrame:
    """``out`` = ``percent_rank()`` over ``v``; see ``add_percent_ranks``."""
    return add_percent_ranks(df, {out: v}, method=method, **kw)


def average_percentile(df: DataFrame, v: str, out: str | None = None, method: str = "histogram",
                       n_buckets: int | None = None) -> DataFrame:
    """Average-rank percentile of ``v`` in percent (ties share the mean of
    their ranks; NULL stays NULL and is not counted), i.e. pandas'
    ``rank(method="average", pct=True) * 100``.

    ``out`` defaults to ``v`` (the value is replaced by its percentile, as the
    lookup service does with its frequency column).
    """
    out = out or v
    if method == "window":
        w_all = Window.partitionBy(F.col(v).isNull())
        w_ord = w_all.orderBy(F.col(v))
        avg_rank = (F.rank().over(w_ord) - 1) + (F.count(F.lit(1)).over(Window.partitionBy(v)) + 1) / 2.0
        pct = avg_rank / F.count(v).over(w_all) * 100.0
        return df.withColumn(out, F.when(F.col(v).isNull(), F.lit(None).cast("double")).otherwise(pct))
    # read by the quantiles and by the exchange
    ranked = Ranked(df if df.is_cached else materialize(df), [v], [], n_buckets)
    known = max(ranked.n - ranked.n_null[0], 1)
    pct = (F.col("_less") - ranked.n_null[0] + (F.col("_peers") + 1) / 2.0) / F.lit(float(known)) * 100.0
    value = F.when(F.col("_row")[v].isNotNull(), pct)
    columns = [value.alias(out) if c == out else F.col("_row")[c].alias(c) for c in df.columns]
    return ranked.entries.select(*columns, *([value.alias(out)] if out not in df.columns else []))
