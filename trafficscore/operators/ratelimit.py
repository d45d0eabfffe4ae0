"""Anchored fixed-window rate limiter per client (batch form).

Semantics: per client, a window opens at the first request and at the first
request more than ``window`` seconds after the current window's start (a
request exactly ``window`` seconds later still belongs to it).  The request
that opens a window counts 1; a request is over the limit when its count
exceeds ``limit``.

One path for every client:

1. *starts*: only (client, slice, time) go to Python, sorted; a ``mapInArrow`` pass
   finds the window starts.  Requests after a gap longer than the window open one
   whatever came before (told for a whole batch at once); within longer sessions a binary
   search jumps from start to start.  State between Arrow batches: one row.
2. *counts* (JVM): starts are put among the requests as marker rows, and one window
   function over (client, slice) in time order carries the last marker's start on and counts
   the requests since.  That is one exchange and one sort of the requests; payload
   columns never leave the JVM.

A *hot* client (more rows than an average partition, at least ``min_hot_rows``) is cut
into time slices of about that many rows (quantiles of its times, at least one window
apart), so its requests are searched, sorted and counted by as many tasks.  What a slice must know is
the window that is open when it begins, and how many requests it has:

3. *transfer functions*: each slice is read once by itself.  The open window's start only
   matters by the first request it doesn't reach, so the slice's outgoing window as a
   function of the incoming start is a step function over the requests of its first window
   length; the chains of starts from all of them are followed at once by repeated squaring of
   the slice's next-start table.  Equal neighbouring steps are merged.
4. *composition*: a step leads to the step of the next slice that its outgoing start falls
   in.  From each client's first step, pointer doubling over these links (twice as many
   slices a round) reaches the one step per slice that is really taken.
5. the incoming window of each slice (one row a slice) is a marker row before its requests.

Slices are at least a window long, so a window touches two of them at most.  A slice holds
its distinct times (8 bytes each) while its steps are computed.  A NULL client key is a client like
any other.  Python sees the key and epoch microseconds as Arrow values, so numeric keys
keep every digit and far-off clocks are harmless.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StructField, StructType)

from trafficscore.functions.scalars import epoch_micros
from trafficscore.plans.strategies import materialize, shuffle_partitions

# Limiter window (seconds) and request limit.
WINDOW_SECONDS = 60
MAX_REQUESTS = 10
# A client below this many rows is never hot: one task sorts its requests.
MIN_HOT_ROWS = 5_000_000

_TS = "_ts_us"
_WS = "_ws_us"
_HOT = "_hot_id"
_SLICE = "_slice"
_NEVER = -(1 << 62)      # before any request: no window is open


def fold_run(ts: np.ndarray, ws: int, cnt: int, window_us: int):
    """Fold one client's requests (sorted int64 micros) from state (ws, cnt).

    Returns per-request window starts and counts, and the final state.
    """
    n = len(ts)
    out_ws = np.empty(n, dtype=np.int64)
    out_cnt = np.empty(n, dtype=np.int64)
    i = 0
    while i < n:
        if ts[i] - ws > window_us:
            ws, cnt = int(ts[i]), 0
        j = int(np.searchsorted(ts, ws + window_us, side="right"))
        if j <= i:
            j = i + 1
        out_ws[i:j] = ws
        out_cnt[i:j] = np.arange(cnt + 1, cnt + 1 + (j - i), dtype=np.int64)
        cnt += j - i
        i = j
    return out_ws, out_cnt, ws, cnt


def _changes(keys: pa.Array) -> np.ndarray:
    """True where a value differs from the one before (NULL equals NULL)."""
    out = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _start_batches(window_us: int):
    """``mapInArrow`` function over batches (key, slice, incoming start or NULL, ts)
    sorted by key, slice and ts: (key, slice, start) of all windows that open."""
    def run(batches):
        last = None                     # key, slice, ts and window start of the row before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0)
            slices, ts = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            head = _changes(keys)
            head[1:] |= slices[1:] != slices[:-1]
            head[0] = last is None or (keys[0].as_py(), int(slices[0])) != last[:2]
            step = np.diff(ts, prepend=ts[0] if head[0] else last[2])
            # a slice goes on with its incoming window while that is open
            incoming = batch.column(2).fill_null(_NEVER).to_numpy()
            opens = np.where(head, ts - incoming > window_us, step > window_us)
            begins = np.flatnonzero(head | opens)
            if not len(begins) or begins[0]:
                begins = np.insert(begins, 0, 0)
            start = np.where(opens[begins], ts[begins], incoming[begins])
            if not (head[0] or opens[0]):
                start[0] = last[3]
            ends = np.append(begins[1:], n)
            more = []
            at = int(start[-1])
            for k in np.flatnonzero(ts[ends - 1] - start > window_us).tolist():
                b, ws = int(ends[k]), int(start[k])
                i, own = int(begins[k]), ts[begins[k]:ends[k]].tolist()
                first = i
                while True:
                    i = first + bisect_right(own, ws + window_us, i - first)
                    if i >= b:
                        break
                    ws = own[i - first]
                    more.append(i)
                if k == len(begins) - 1:
                    at = ws
            last = (keys[n - 1].as_py(), int(slices[-1]), int(ts[-1]), at)
            rows = pa.array(np.sort(np.concatenate([np.flatnonzero(opens), np.array(more, dtype=np.int64)])))
            yield pa.RecordBatch.from_arrays([keys.take(rows), batch.column(1).take(rows), batch.column(3).take(rows)],
                                             names=[batch.schema.names[0], _SLICE, _WS])
    return run


def transfer(times: np.ndarray, counts: np.ndarray, window_us: int):
    """Steps (low, exit, tail) of one slice's transfer function.

    ``times``: its distinct times, ascending, with ``counts`` rows each.  A window that
    opened at ``s`` before the slice takes the last step with ``low`` <= s: the slice's last
    window opens at ``exit`` and has ``tail`` rows of the slice; ``exit`` is ``_NEVER`` where no
    window opens (the incoming one is over before the next slice)."""
    n = len(times)
    ends = np.searchsorted(times, times + window_us, side="right")
    last = np.where(ends < n, ends, np.arange(n))          # the next start, itself at the end of a chain
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # entry e: the incoming window reaches the times before e
    n_entries = int(np.searchsorted(times, times[0] + window_us, side="left")) + 1
    low = np.concatenate([[_NEVER], times[:n_entries - 1] - window_us])
    to = np.append(last, n)[:n_entries]
    exits = np.append(times, _NEVER)[to]
    after = np.append(np.cumsum(counts[::-1])[::-1], 0)
    keep = np.append(True, exits[1:] != exits[:-1])
    return low[keep], exits[keep], after[to][keep]


def _transfer_batches(window_us: int):
    """``mapInArrow`` function over batches (hot id, slice, ts) sorted by all three."""
    def steps(own, parts):
        times, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        times, first = np.unique(times, return_index=True)
        counts = np.add.reduceat(counts, first)
        low, exits, tail = transfer(times, counts, window_us)
        ids = [pa.array(np.full(len(low), v, dtype=np.int32)) for v in own]
        return pa.RecordBatch.from_arrays([*ids, pa.array(low), pa.array(exits), pa.array(tail)],
                                          names=[_HOT, _SLICE, "low", "exit", "tail"])

    def run(batches):
        own, parts = None, []
        for batch in batches:
            ids, slices, ts = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(slices) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ts)], strict=True):
                if a == b:
                    continue
                group = (int(ids[a]), int(slices[a]))
                if own is not None and group != own:
                    yield steps(own, parts)
                    parts = []
                own = group
                parts.append(np.unique(ts[a:b], return_counts=True))
        if own is not None:
            yield steps(own, parts)
    return run


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


class Hot(NamedTuple):
    """Hot clients: ``table`` (_key, hot id, slice bounds as two levels of arrays), one row a client."""
    table: DataFrame
    most_slices: int


def _hot_clients(base: DataFrame, key_col: str, parts: int, hot_rows: int | None, min_hot_rows: int,
                 window_us: int) -> Hot | None:
    """Hot clients and the bounds of their slices, or None.  At most
    total / threshold clients are hot, and they have some total / threshold bounds,
    which is the number of partitions: what reaches the driver is bounded by that."""
    total = base.count()
    threshold = max(hot_rows if hot_rows is not None else max(-(-total // parts), min_hot_rows), 1)
    if total <= threshold:
        return None
    found = (base.groupBy(key_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
             .limit(total // threshold + 1).collect())
    if not found:
        return None
    spark = base.sparkSession
    kind = base.schema[key_col].dataType
    keys = spark.createDataFrame([(r[key_col], i, r["n"]) for i, r in enumerate(found)],
                                 StructType([StructField("_key", kind), StructField(_HOT, IntegerType()),
                                             StructField("_n", LongType())]))
    most = max(-(-r["n"] // threshold) for r in found)
    # quantiles for the largest client; smaller ones keep every so many of them
    shares = [i / most for i in range(1, max(most, 2))]
    bounds = (base.select(key_col, _TS).join(F.broadcast(keys), _same(key_col, "_key")).groupBy(_HOT, "_n")
              .agg(F.percentile_approx(_TS, shares, max(10_000, 4 * most)).alias("b"))
              .select(_HOT, F.expr(f"filter(b, (x, i) -> (i + 1) % greatest(1, cast({most} * {threshold} / _n as int)) = 0)")
                      .alias("b")).collect())
    # bounds of a client are more than a window apart, so a window touches two slices at most
    own: dict[int, list[int]] = {}
    for r in bounds:
        kept = own.setdefault(r[_HOT], [])
        for b in r["b"]:
            if not kept or b - kept[-1] > window_us:
                kept.append(b)
    rows = []
    for i, r in enumerate(found):
        kept = own.get(i, [])
        step = max(1, math.isqrt(len(kept)))
        fine = [kept[k:k + step] for k in range(0, len(kept), step)]
        rows.append((r[key_col], i, step, [f[0] for f in fine], fine))
    longs = ArrayType(LongType())
    table = spark.createDataFrame(rows, StructType([
        StructField("_key", kind), StructField(_HOT, IntegerType()), StructField("_step", IntegerType()),
        StructField("_coarse", longs), StructField("_fine", ArrayType(longs))]))
    return Hot(table, 1 + max(len(b) for b in own.values()))


def _sliced(base: DataFrame, key_col: str, hot: Hot | None) -> DataFrame:
    """``base`` with its hot id (NULL for other clients) and slice (the number of bounds up to its time)."""
    if hot is None:
        return base.withColumns({_HOT: F.lit(None).cast("int"), _SLICE: F.lit(0)})

    def below(bounds):
        return F.size(F.filter(bounds, lambda b: b <= F.col(_TS)))

    coarse = below(F.col("_coarse"))
    inner = (coarse - 1) * F.col("_step") + below(F.element_at(F.col("_fine"), F.greatest(coarse, F.lit(1))))
    at = F.when(F.col(_HOT).isNull() | (F.size("_coarse") == 0) | (coarse == 0), F.lit(0)).otherwise(inner).cast("int")
    return (base.join(F.broadcast(hot.table), _same(key_col, "_key"), "left").withColumn(_SLICE, at)
            .select(*base.columns, _HOT, _SLICE))


def _incoming(rows: DataFrame, hot: Hot, window_us: int, parts: int) -> DataFrame:
    """(hot id, slice, incoming start, its rows so far) of slices that begin within a window; one row a slice."""
    ordered = (rows.where(F.col(_HOT).isNotNull()).select(_HOT, _SLICE, _TS).repartition(parts, _HOT, _SLICE)
               .sortWithinPartitions(_HOT, _SLICE, _TS))
    steps = materialize(ordered.mapInArrow(_transfer_batches(window_us),
                                           f"{_HOT} int, {_SLICE} int, low long, exit long, tail long"))
    # where a step's exit falls among the next slice's steps (slices follow each other without holes)
    ends = steps.select(_HOT, (F.col(_SLICE) + 1).alias(_SLICE), F.col("exit").alias("low"), F.lit(1).alias("_probe"),
                        F.col("low").alias("_from"), "exit", "tail")
    at = Window.partitionBy(_HOT, _SLICE).orderBy("low", "_probe")
    link = (steps.select(_HOT, _SLICE, "low", F.lit(0).alias("_probe")).unionByName(ends, allowMissingColumns=True)
            .withColumn("_to", F.last(F.when(F.col("_probe") == 0, F.col("low")), ignorenulls=True).over(at))
            .where("_probe = 1"))
    here = [F.col(_HOT), (F.col(_SLICE) - 1).alias(_SLICE), F.col("_from").alias("low")]
    link = materialize(link.select(*here, F.col(_SLICE).alias("_at"), "_to", "exit", "tail"))
    jump = link.where("_to is not null").select(_HOT, _SLICE, "low", "_at", "_to")
    first = F.row_number().over(Window.partitionBy(_HOT).orderBy(_SLICE, "low"))
    taken = steps.withColumn("_i", first).where("_i = 1").select(_HOT, _SLICE, "low")
    for _ in range(max(hot.most_slices - 1, 1).bit_length()):
        onward = jump.select(_HOT, F.col(_SLICE).alias("_at"), F.col("low").alias("_to"),
                             F.col("_at").alias("_at2"), F.col("_to").alias("_to2"))
        reached = taken.join(jump, [_HOT, _SLICE, "low"]).select(_HOT, F.col("_at").alias(_SLICE), F.col("_to").alias("low"))
        taken = materialize(taken.unionByName(reached), "checkpoint")
        jump = materialize(jump.join(onward, [_HOT, "_at", "_to"])
                           .select(_HOT, _SLICE, "low", F.col("_at2").alias("_at"), F.col("_to2").alias("_to")), "checkpoint")
    return (link.join(taken, [_HOT, _SLICE, "low"]).where(F.col("exit") > _NEVER)
            .select(_HOT, F.col("_at").alias(_SLICE), F.col("exit").alias("_in"), F.col("tail").alias("_carried")))


def slice_sizes(df: DataFrame, key_col: str = "client_ip", ts_col: str = "timestamp",
                window_seconds: float = WINDOW_SECONDS, partitions: int | None = None, hot_rows: int | None = None,
                min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """(key, slice, rows): the requests that one task of ``rate_limit_batch`` would read together."""
    window_us = int(round(window_seconds * 1_000_000))
    base = df.where(F.col(ts_col).isNotNull()).withColumn(_TS, epoch_micros(ts_col))
    hot = _hot_clients(base, key_col, partitions or shuffle_partitions(df), hot_rows, min_hot_rows, window_us)
    return _sliced(base, key_col, hot).groupBy(key_col, F.col(_SLICE).alias("slice")).agg(F.count(F.lit(1)).alias("rows"))


def rate_limit_batch(df: DataFrame, key_col: str = "client_ip", ts_col: str = "timestamp",
                     tie_col: str | None = None, window_seconds: float = WINDOW_SECONDS,
                     limit: int = MAX_REQUESTS, partitions: int | None = None,
                     split_hot_clients: bool = True, hot_rows: int | None = None,
                     min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add ``window_start`` (timestamp), ``request_count`` and ``over_limit``.

    Requests are ordered by time, then by ``tie_col`` (e.g. a request id; by
    default a hash of the row) so equal timestamps fold deterministically.
    Rows with a NULL timestamp are not requests and are dropped.  Clients
    with more rows than an average partition and at least ``min_hot_rows``
    are hot (``hot_rows`` sets the threshold directly).
    """
    from trafficscore.session import ship_package
    ship_package(df.sparkSession)
    window_us = int(round(window_seconds * 1_000_000))
    parts = partitions or shuffle_partitions(df)
    base = df.where(F.col(ts_col).isNotNull()).withColumn(_TS, epoch_micros(ts_col))
    # without a tie column, equal times still come in one fixed order
    tie = tie_col or "_tie"
    if tie_col is None:
        base = base.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
    hot = _hot_clients(base, key_col, parts, hot_rows, min_hot_rows, window_us) if split_hot_clients else None
    rows = _sliced(base, key_col, hot)

    times = rows.select(key_col, _HOT, _SLICE, _TS)
    if hot is None:
        times = times.withColumn("_in", F.lit(None).cast("long"))
    else:
        incoming = materialize(_incoming(rows, hot, window_us, parts))
        # one row a slice: as few as there are partitions
        times = times.join(F.broadcast(incoming.select(_HOT, _SLICE, "_in")), [_HOT, _SLICE], "left")
    ordered = (times.select(key_col, _SLICE, "_in", _TS).repartition(parts, key_col, _SLICE)
               .sortWithinPartitions(key_col, _SLICE, _TS))
    schema = StructType([base.schema[key_col], StructField(_SLICE, IntegerType()), StructField(_WS, LongType())])
    marks = (ordered.mapInArrow(_start_batches(window_us), schema)
             .select(key_col, _SLICE, F.col(_WS).alias(_TS), _WS, F.lit(0).cast("long").alias("_carried")))
    if hot is not None:
        marks = marks.unionByName(
            incoming.join(F.broadcast(hot.table.select(F.col("_key").alias(key_col), _HOT)), _HOT)
            .select(key_col, _SLICE, F.lit(_NEVER).alias(_TS), F.col("_in").alias(_WS), "_carried"))

    among = (rows.drop(_HOT).withColumn("_real", F.lit(1))
             .unionByName(marks.withColumn("_real", F.lit(0)), allowMissingColumns=True))
    so_far = (Window.partitionBy(key_col, _SLICE).orderBy(_TS, "_real", tie)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = among.withColumns({"_n": F.sum("_real").over(so_far), "_open": F.last(_WS, ignorenulls=True).over(so_far)})
    before = F.last(F.when(F.col("_real") == 0, F.col("_n") - F.col("_carried")), ignorenulls=True).over(so_far)
    return (counted.withColumn("request_count", (F.col("_n") - before).cast("long")).where("_real = 1")
            .select(*[c for c in base.columns if c not in (_TS, "_tie")], "request_count",
                    (F.col("request_count") > limit).alias("over_limit"),
                    F.timestamp_micros("_open").alias("window_start")))
