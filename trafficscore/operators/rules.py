"""Threshold rules on RFM measures, the lookup join and the request decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.functions.scalars import nan_to_null
from trafficscore.operators.clean import PROTECTED_PATHS, protected_requests
from trafficscore.operators.ranks import average_percentile
from trafficscore.plans.strategies import BROADCAST_MAX_ROWS, size_checked_join

# Client labels of the classification rule.
LABEL_FLOOD = "DDoS - Flood Attack"
LABEL_AMPLIFICATION = "DDoS - Amplification Attack"
LABEL_SUSPICIOUS = "Suspicious - Needs Monitoring"
LABEL_LEGITIMATE = "Legitimate User"
LABEL_UNCERTAIN = "Uncertain - Possibly Legit or Slow-Rate Attack"

# Classification thresholds (recency in days, raw frequency, monetary).
CLASSIFY_LOW_RECENCY = 1 / 1440
CLASSIFY_HIGH_FREQUENCY = 100
CLASSIFY_LOW_MONETARY = 100
CLASSIFY_HIGH_MONETARY = 1200

# Verdict thresholds (recency in days, frequency percentile, monetary).
VERDICT_MAX_RECENCY = 1
VERDICT_FREQ_PCT = 50
VERDICT_LOW_MONETARY = 100
VERDICT_HIGH_MONETARY = 1200

# Sentinel of an unknown client, and the loopback override.
UNKNOWN = -1
LOOPBACK = "127.0.0.1"


def classify_clients(df: DataFrame, recency_col: str = "recency_days", frequency_col: str = "frequency",
                     monetary_col: str = "monetary", out: str = "label",
                     low_recency: float = CLASSIFY_LOW_RECENCY, high_frequency: float = CLASSIFY_HIGH_FREQUENCY,
                     low_monetary: float = CLASSIFY_LOW_MONETARY,
                     high_monetary: float = CLASSIFY_HIGH_MONETARY) -> DataFrame:
    """Five-label rule (all comparisons strict; a missing value fails its test).

    recent and frequent -> flood (low monetary) / amplification (high) /
    suspicious (between); otherwise frequency <= limit -> legitimate; else
    uncertain.
    """
    r, f, m = (nan_to_null(c) for c in (recency_col, frequency_col, monetary_col))
    label = (F.when((r < low_recency) & (f > high_frequency),
                    F.when(m < low_monetary, F.lit(LABEL_FLOOD))
                    .when(m > high_monetary, F.lit(LABEL_AMPLIFICATION))
                    .otherwise(F.lit(LABEL_SUSPICIOUS)))
             .when(f <= high_frequency, F.lit(LABEL_LEGITIMATE))
             .otherwise(F.lit(LABEL_UNCERTAIN)))
    return df.withColumn(out, label)


def suspicion_verdict(df: DataFrame, recency_col: str = "recency_days", frequency_col: str = "frequency",
                      monetary_col: str = "monetary", out: str = "suspicious",
                      max_recency_days: float = VERDICT_MAX_RECENCY, freq_pct: float = VERDICT_FREQ_PCT,
                      low_monetary: float = VERDICT_LOW_MONETARY, high_monetary: float = VERDICT_HIGH_MONETARY,
                      unknown_policy: str = "compat") -> DataFrame:
    """Suspicious flag from (recency days, frequency percentile, monetary).

    recent and frequent -> monetary outside [low, high]; frequency <= pct ->
    False; frequent but not recent -> True.  Unknown clients carry the -1
    sentinel; ``compat`` lets the rule run on it (-> False, as shipped),
    ``suspicious`` flags them.
    """
    r, f, m = (nan_to_null(c) for c in (recency_col, frequency_col, monetary_col))
    verdict = (F.when((r < max_recency_days) & (f > freq_pct),
                      F.coalesce((m < low_monetary) | (m > high_monetary), F.lit(False)))
               .when(f <= freq_pct, F.lit(False))
               .otherwise(F.lit(True)))
    if unknown_policy == "suspicious":
        verdict = F.when(F.col(recency_col) == UNKNOWN, F.lit(True)).otherwise(verdict)
    elif unknown_policy != "compat":
        raise ValueError(f"unknown_policy must be 'compat' or 'suspicious', got {unknown_policy!r}")
    return df.withColumn(out, verdict)


def build_lookup_table(rfm: DataFrame, key_col: str = "client_ip",
                       method: str = "histogram", **rank_kw) -> DataFrame:
    """Lookup table of the decision service: frequency replaced by its
    average percentile over the whole table, then only keys that occur
    exactly once (a duplicated key is treated as unknown).

    The duplicate guard is a grouped count (partial aggregation), not a
    window, so a key repeated many times cannot overload one task.
    """
    ranked = average_percentile(rfm, "frequency", method=method, **rank_kw)
    value_cols = [c for c in ("recency_days", "frequency", "monetary") if c in ranked.columns]
    g = (ranked.where(F.col(key_col).isNotNull()).groupBy(key_col)
         .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in value_cols]))
    return g.where(F.col("_n") == 1).drop("_n")


def lookup_rfm(requests: DataFrame, table: DataFrame, key_col: str = "client_ip",
               broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Attach (recency_days, frequency, monetary) to each request; unknown
    clients get the -1 sentinel in all three.  A table without a monetary
    column yields NULL monetary for known clients."""
    j = size_checked_join(requests, known_side(table, key_col), [key_col], how="left", broadcast_max_rows=broadcast_max_rows)
    return unknown_as_sentinel(j)


def known_side(table: DataFrame, key_col: str = "client_ip") -> DataFrame:
    """The lookup table as a join's side: its measures, and ``_found``."""
    t = table if "monetary" in table.columns else table.withColumn("monetary", F.lit(None).cast("double"))
    return t.select(key_col, "recency_days", "frequency", "monetary", F.lit(True).alias("_found"))


def unknown_as_sentinel(joined: DataFrame) -> DataFrame:
    """-1 in all measures of rows that the join didn't find."""
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.withColumns({c: F.when(found, F.col(c).cast("double")).otherwise(F.lit(float(UNKNOWN)))
                               for c in ("recency_days", "frequency", "monetary")}).drop("_found")


def lookup_point(table: DataFrame, ip: str, key_col: str = "client_ip") -> DataFrame:
    """One-row lookup of a single address (the lookup service's query):
    (recency_days, frequency, monetary) of ``ip``, or -1 in all three when
    the table does not hold exactly one row for it.  ``table`` is a raw RFM
    table or one from ``build_lookup_table``; the equality filter is pushed
    to the scan."""
    one = table.where(F.col(key_col) == F.lit(ip))
    cols = [c for c in ("recency_days", "frequency", "monetary") if c in table.columns]
    agg = one.agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])
    return agg.select(F.lit(ip).alias(key_col), *[
        F.when(F.col("_n") == 1, F.col(c).cast("double")).otherwise(F.lit(float(UNKNOWN))).alias(c)
        for c in cols])


def verdict_for(lookup_table: DataFrame, ip: str, key_col: str = "client_ip",
                unknown_policy: str = "compat", **verdict_kw) -> DataFrame:
    """Suspicious flag of one address (empty address -> False)."""
    if not ip:
        return lookup_table.sparkSession.createDataFrame([(ip, False)], f"{key_col} string, suspicious boolean")
    v = suspicion_verdict(lookup_point(lookup_table, ip, key_col), unknown_policy=unknown_policy, **verdict_kw)
    return v.select(key_col, "suspicious")


def judge_limited(limited: DataFrame, lookup_table: DataFrame, key_col: str = "client_ip",
                  unknown_policy: str = "compat", verdict_kw: dict | None = None,
                  broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Verdict and decision for rate-limited requests, in one pass.

    Only over-limit requests from a real, non-loopback address are looked
    up: the join key is NULL for every other row, so those rows never match
    (no lookup, no skew - a NULL key is spread like any hot key when the
    join shuffles).  Loopback is always suspicious; no address never is.
    """
    key = F.col(key_col)
    over = F.col("over_limit")
    no_address = key.isNull() | (key == "")
    keyed = limited.withColumn("_lookup", F.when(over & ~no_address & (key != LOOPBACK), key))
    table = lookup_table.withColumnRenamed(key_col, "_lookup")
    looked = lookup_rfm(keyed, table, key_col="_lookup", broadcast_max_rows=broadcast_max_rows)
    judged = suspicion_verdict(looked, unknown_policy=unknown_policy, **(verdict_kw or {}))
    no_monetary = "monetary" not in lookup_table.columns
    suspicious = (F.when(~over | no_address, F.lit(False))
                  .when(key == LOOPBACK, F.lit(True))
                  .otherwise(F.lit(False) if no_monetary else F.col("suspicious")))
    looked_up = over & ~no_address & (key != LOOPBACK)
    out = judged.withColumns({
        "suspicious": suspicious,
        **{c: F.when(looked_up, F.col(c)) for c in ("recency_days", "frequency", "monetary")},
    }).drop("_lookup")
    return out.withColumn("decision", F.when(over & F.col("suspicious"), F.lit("challenge"))
                          .otherwise(F.lit("allow")))


def decide_requests(access_log: DataFrame, lookup_table: DataFrame, key_col: str = "client_ip",
                    ts_col: str = "timestamp", tie_col: str | None = None, window_seconds: float = 60,
                    limit: int = 10, paths=PROTECTED_PATHS, verified: DataFrame | None = None,
                    unknown_policy: str = "compat", verdict_kw: dict | None = None,
                    broadcast_max_rows: int = BROADCAST_MAX_ROWS, **limiter_kw) -> DataFrame:
    """Allow / challenge per protected request.

    Protected, unverified requests go through the anchored rate limiter; only
    over-limit requests are looked up (loopback is always suspicious, a
    lookup that finds nothing follows ``unknown_policy``).  ``decision`` is
    ``challenge`` when over the limit and suspicious, else ``allow``.
    """
    from trafficscore.operators.ratelimit import rate_limit_batch

    req = protected_requests(access_log, paths=paths, verified=verified, key_col=key_col)
    limited = rate_limit_batch(req, key_col=key_col, ts_col=ts_col, tie_col=tie_col,
                               window_seconds=window_seconds, limit=limit, **limiter_kw)
    return judge_limited(limited, lookup_table, key_col=key_col, unknown_policy=unknown_policy,
                         verdict_kw=verdict_kw, broadcast_max_rows=broadcast_max_rows)
