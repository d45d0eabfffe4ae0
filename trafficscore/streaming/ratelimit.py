"""Anchored per-client rate limiter over a stream, with keyed state.

``mode="arrival"`` (default): every micro-batch is folded as it comes (rows
of one batch in time order), by ``transformWithState`` with the open window
``(start, count)`` of a client as its value state - the request-time behaviour of
the original limiter.  No row is ever dropped.  The state has a time to live: a client
not seen for ``window_seconds`` + ``lag_seconds`` of processing time has no open window any
more (rows reach the stream at most ``lag_seconds`` after their timestamp), so its state ends and
the next batch removes it.  A call reads its client's rows chunk by chunk, keeps 16 bytes of
each (time and tie) to sort them, and hands the result out in chunks.  The operator needs the
RocksDB state store; start the query inside ``limiter_state``.

``mode="event_time"``: rows are ordered by their own timestamps, not by
arrival, so files delivered out of order give the same counts as the batch
limiter.  Per client the state holds the open window and a buffer of
not-yet-final requests ``(us, tie)``; each call adds the new rows and folds,
in (time, tie) order, the rows at or below the watermark.  An event-time
timeout at the earliest buffered row releases it when the watermark passes.
Spark's stateful operator discards input rows that arrive later than the
watermark before they reach the fold (reported as
``numRowsDroppedByWatermark``, see ``rows_dropped_by_watermark``), so the
delay must cover the disorder of the source; the buffer holds one delay of
each client's traffic.  A call costs milliseconds whatever its rows, so backlogs of many
clients are folded with ``groups``: so many groups of clients (by hash) share a state and
its calls, every client's windows apart.  Without it each client has its own state, which
suits short batches, since a call writes its whole state again.  A drained (``availableNow``) run keeps the last
delay of data buffered until newer data moves the watermark.

In both modes state whose window has expired is removed: an expired window
behaves exactly like no window, so eviction changes nothing.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType)

from trafficscore.functions.scalars import epoch_micros
from trafficscore.operators.ratelimit import MAX_REQUESTS, WINDOW_SECONDS, fold_run

STATE_SCHEMA = StructType([StructField("ws", LongType()), StructField("cnt", LongType()),
                           StructField("buf_us", ArrayType(LongType())), StructField("buf_tie", ArrayType(LongType()))])


# State of a group of clients: each client's open window, and the buffered rows with the
# client's number; 64-bit numbers as bytes, since lists of them are slow to hand over.
GROUP_STATE_SCHEMA = StructType([StructField("keys", ArrayType(StringType())),
                                 *[StructField(c, BinaryType()) for c in ("ws", "cnt", "buf_of", "buf_us", "buf_tie")]])

# Rows of a client that a call hands out at a time.
ROWS_AT_ONCE = 100_000
# Rows reach the stream at most this long after their timestamp.
LAG_SECONDS = 600
_STORE = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def limiter_state(spark: SparkSession, drained: bool = False):
    """Settings of queries started inside: state in RocksDB, and for ``drained``
    (``availableNow``) runs no batches without data, which the time to live would ask for
    without end.  A query keeps the settings it was started with; the session gets its own back."""
    own = {_STORE: _ROCKS, **({_IDLE: "false"} if drained else {})}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ArrivalLimiter(StatefulProcessor):
    """Folds a client's rows of a micro-batch onto its open window."""

    def __init__(self, window_us: int, limit: int, ttl_ms: int):
        self.window_us, self.limit, self.ttl_ms = window_us, limit, ttl_ms

    def init(self, handle) -> None:
        self.window = handle.getValueState("window", "ws long, cnt long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        parts = [(p["ts_us"].to_numpy(dtype=np.int64), p["tie"].to_numpy(dtype=np.int64)) for p in rows if len(p)]
        us, tie = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((tie, us))
        us, tie = us[order], tie[order]
        ws, cnt = self.window.get() if self.window.exists() else (int(us[0]) - self.window_us - 1, 0)
        for at in range(0, len(us), ROWS_AT_ONCE):
            own = slice(at, at + ROWS_AT_ONCE)
            starts, counts, ws, cnt = fold_run(us[own], int(ws), int(cnt), self.window_us)
            yield pd.DataFrame({"_key": pd.Series([key[0]] * len(starts), dtype=object), "_tie": tie[own], "_ts_us": us[own],
                                "_ws_us": starts, "request_count": counts, "over_limit": counts > self.limit})
        self.window.update((int(ws), int(cnt)))

    def close(self) -> None:
        pass


def _output_schema(key_field: StructField) -> StructType:
    return StructType([key_field, StructField("_tie", LongType()), StructField("_ts_us", LongType()),
                       StructField("_ws_us", LongType()), StructField("request_count", LongType()),
                       StructField("over_limit", BooleanType())])


def _make_func(key_name: str, window_us: int, limit: int):
    def func(key, pdfs, state):
        if state.exists:
            ws, cnt, buf_us, buf_tie = state.get
            buf_us = np.asarray(buf_us or [], dtype=np.int64)
            buf_tie = np.asarray(buf_tie or [], dtype=np.int64)
        else:
            ws, cnt = 0, 0
            buf_us = np.empty(0, dtype=np.int64)
            buf_tie = np.empty(0, dtype=np.int64)
        new = [p for p in pdfs if len(p)]
        us = np.concatenate([buf_us] + [p["_ts_us"].to_numpy(dtype=np.int64) for p in new])
        tie = np.concatenate([buf_tie] + [p["_tie"].to_numpy(dtype=np.int64) for p in new])
        order = np.lexsort((tie, us))
        us, tie = us[order], tie[order]
        wm_us = state.getCurrentWatermarkMs() * 1000
        n_rel = int(np.searchsorted(us, wm_us, side="right"))
        rel_us, rel_tie = us[:n_rel], tie[:n_rel]
        keep_us, keep_tie = us[n_rel:], tie[n_rel:]
        if n_rel:
            w, c, ws, cnt = fold_run(rel_us, int(ws), int(cnt), window_us)
            yield pd.DataFrame({key_name: [key[0]] * n_rel, "_tie": rel_tie, "_ts_us": rel_us, "_ws_us": w,
                                "request_count": c, "over_limit": c > limit})
        if len(keep_us):
            state.update((int(ws), int(cnt), keep_us.tolist(), keep_tie.tolist()))
            state.setTimeoutTimestamp(max(int(keep_us[0]) // 1000, state.getCurrentWatermarkMs()))
        elif ws + window_us > wm_us:
            state.update((int(ws), int(cnt), [], []))
            state.setTimeoutTimestamp(max((ws + window_us) // 1000 + 1, state.getCurrentWatermarkMs()))
        else:
            state.remove()
    return func


def _make_group_func(window_us: int, limit: int):
    """``_make_func`` for the rows of many clients, told by their text ``_key``."""
    def func(group, pdfs, state):
        names, ws, cnt, of, us, tie = [], *[np.empty(0, dtype=np.int64)] * 5
        if state.exists:
            names, *numbers = state.get
            names = list(names)
            ws, cnt, of, us, tie = (np.frombuffer(bytes(x), dtype=np.int64) for x in numbers)
        number = {name: i for i, name in enumerate(names)}
        parts = [(of, us, tie)]
        for p in pdfs:
            if len(p):
                codes, own = pd.factorize(p["_key"], use_na_sentinel=False)
                places = [number.setdefault(None if pd.isna(name) else name, len(number)) for name in own]
                parts.append((np.array(places, dtype=np.int64)[codes], p["_ts_us"].to_numpy(dtype=np.int64),
                              p["_tie"].to_numpy(dtype=np.int64)))
        of, us, tie = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.zeros(len(number) - len(names), dtype=np.int64)
        ws, cnt = np.concatenate([ws, new]), np.concatenate([cnt, new])
        names = np.array([*number, None], dtype=object)[:-1]
        order = np.lexsort((tie, us, of))
        of, us, tie = of[order], us[order], tie[order]
        wm_ms = state.getCurrentWatermarkMs()
        wm_us = wm_ms * 1000
        final = us <= wm_us
        rel_of, rel_us, rel_tie = of[final], us[final], tie[final]
        if len(rel_of):
            cuts = np.r_[0, np.flatnonzero(np.diff(rel_of)) + 1, len(rel_of)].tolist()
            w, c = np.empty_like(rel_us), np.empty_like(rel_us)
            for a, b in zip(cuts, cuts[1:], strict=False):
                i = rel_of[a]
                w[a:b], c[a:b], ws[i], cnt[i] = fold_run(rel_us[a:b], int(ws[i]), int(cnt[i]), window_us)
            for at in range(0, len(rel_of), ROWS_AT_ONCE):
                own = slice(at, at + ROWS_AT_ONCE)
                yield pd.DataFrame({"_key": names[rel_of[own]], "_tie": rel_tie[own], "_ts_us": rel_us[own],
                                    "_ws_us": w[own], "request_count": c[own], "over_limit": c[own] > limit})
        of, us, tie = of[~final], us[~final], tie[~final]
        stays = ws + window_us > wm_us
        due = np.where(stays, (ws + window_us) // 1000 + 1, np.iinfo(np.int64).max)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        stays[of] = True
        due[of[first]] = us[first] // 1000
        if stays.any():
            of = (np.cumsum(stays) - 1)[of]
            state.update((names[stays].tolist(), *[x.tobytes() for x in (ws[stays], cnt[stays], of, us, tie)]))
            state.setTimeoutTimestamp(max(int(due.min()), wm_ms))
        else:
            state.remove()
    return func


def rate_limit_stream(stream: DataFrame, key_col: str = "client_ip", ts_col: str = "timestamp",
                      tie_col: str | None = None, window_seconds: float = WINDOW_SECONDS,
                      limit: int = MAX_REQUESTS, mode: str = "arrival",
                      delay: str = "10 minutes", lag_seconds: float = LAG_SECONDS,
                      groups: int | None = None) -> DataFrame:
    """Streaming limiter.  Output (append mode): ``key, <tie_col>, timestamp,
    window_start, request_count, over_limit`` per request."""
    from trafficscore.session import ship_package
    ship_package(stream.sparkSession)
    window_us = int(round(window_seconds * 1_000_000))
    # without a tie column, a hash of the row orders equal times deterministically
    tie = F.col(tie_col).cast("long") if tie_col else F.xxhash64(*[F.col(c) for c in stream.columns])
    s = stream.where(F.col(ts_col).isNotNull())
    rows = [key_col, ts_col, tie.alias("_tie"), epoch_micros(ts_col).alias("_ts_us")]
    if mode == "event_time":
        s = s.withWatermark(ts_col, delay).select(*rows)
    if mode == "event_time" and groups:
        # the key as text, as below
        key = s.schema[key_col]
        text = F.col(key_col).cast("string")
        s = s.select(F.pmod(F.xxhash64(text), F.lit(groups)).alias("_group"), text.alias("_key"), ts_col, "_tie", "_ts_us")
        out = s.groupBy("_group").applyInPandasWithState(
            _make_group_func(window_us, limit), _output_schema(StructField("_key", StringType())), GROUP_STATE_SCHEMA,
            "append", GroupStateTimeout.EventTimeTimeout).withColumn(key_col, F.col("_key").cast(key.dataType))
    elif mode == "event_time":
        out = s.groupBy(key_col).applyInPandasWithState(
            _make_func(key_col, window_us, limit), _output_schema(s.schema[key_col]), STATE_SCHEMA, "append",
            GroupStateTimeout.EventTimeTimeout)
    elif mode == "arrival":
        # grouped by the key's text, which pandas keeps as it is (NULL keys, longs beyond 2**53);
        # Spark hands rows over as named tuples, whose names can't begin with "_"
        key = s.schema[key_col]
        s = s.select(F.col(key_col).cast("string").alias("_key"), tie.alias("tie"), epoch_micros(ts_col).alias("ts_us"))
        ttl_ms = int((window_seconds + lag_seconds) * 1000)
        out = s.groupBy("_key").transformWithStateInPandas(
            ArrivalLimiter(window_us, limit, ttl_ms), _output_schema(StructField("_key", StringType())), "Append",
            "ProcessingTime").withColumn(key_col, F.col("_key").cast(key.dataType))
    else:
        raise ValueError("mode must be 'event_time' or 'arrival'")
    return out.select(key_col, F.col("_tie").alias(tie_col or "tie"),
                      F.timestamp_micros("_ts_us").alias(ts_col), F.timestamp_micros("_ws_us").alias("window_start"),
                      "request_count", "over_limit")


def rows_dropped_by_watermark(query) -> int:
    """Input rows the stateful operators of ``query`` discarded as later than
    the watermark, summed over the progress reports kept by Spark."""
    return sum(op.numRowsDroppedByWatermark or 0 for p in query.recentProgress for op in p.stateOperators)
