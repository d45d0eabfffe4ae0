"""Percentile ranks -> 0..5 scores -> composite score; table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.functions.scalars import score_column
from trafficscore.operators.ranks import add_percent_ranks

# Score buckets and the composite weights (R hundreds, F tens, M units).
RFM_BINS = 5
COMPOSITE_WEIGHTS = (100, 10, 1)
# Fixed value: configured composite threshold of the lookup service.
COMPOSITE_THRESHOLD = 400.0


def score_rfm(raw: DataFrame, last_updated: str | dt.datetime | None = None, key_col: str = "src_ip",
              recency_col: str = "recency_raw", frequency_col: str = "frequency_raw",
              monetary_col: str = "monetary_raw", bins: int = RFM_BINS, min_score: int = 0,
              rank_method: str = "histogram", **rank_kw) -> DataFrame:
    """Scored table: ``src_ip, r_score, f_score, m_score, composite_score, last_updated``.

    Each measure gets a global percent rank; F and M scores grow with the
    rank, R with the inverted rank (recent = high).  Scores are
    ``least(bins, ceil(rank * bins))``, so the lowest value scores 0
    (``min_score=1`` clamps).  ``composite = 100 R + 10 F + M`` as float.
    ``last_updated`` is the run time as ISO text (a constant column).
    """
    ranked = add_percent_ranks(raw, {"r_rank": recency_col, "f_rank": frequency_col,
                                     "m_rank": monetary_col}, method=rank_method, key=key_col, **rank_kw)
    wr, wf, wm = COMPOSITE_WEIGHTS
    scored = ranked.select(
        F.col(key_col).alias("src_ip"),
        score_column("r_rank", False, bins, min_score).alias("r_score"),
        score_column("f_rank", True, bins, min_score).alias("f_score"),
        score_column("m_rank", True, bins, min_score).alias("m_score"),
    )
    if isinstance(last_updated, dt.datetime):
        last_updated = last_updated.isoformat()
    return scored.select(
        "src_ip", "r_score", "f_score", "m_score",
        (F.col("r_score") * wr + F.col("f_score") * wf + F.col("m_score") * wm).cast("float")
        .alias("composite_score"),
        F.lit(last_updated).cast("string").alias("last_updated"),
    )


def flag_by_composite(scores: DataFrame, threshold: float = COMPOSITE_THRESHOLD) -> DataFrame:
    """Clients whose composite score exceeds the configured threshold."""
    return scores.where(F.col("composite_score") > F.lit(threshold))


def merge_scores(old: DataFrame, new: DataFrame, key_col: str = "src_ip") -> DataFrame:
    """Upsert: every key of ``new`` replaces the old row, other old rows stay.

    Both sides hold one row per key, so the anti join's shuffle is balanced.
    """
    return old.join(new.select(key_col), on=key_col, how="left_anti").unionByName(new)


def check_scores_table(scores: DataFrame, key_col: str = "src_ip") -> DataFrame:
    """Rows breaking the scored table's constraints (primary key and
    not-null scores), with the reason; empty when the table is valid.
    The duplicate test is a grouped count (partial aggregation)."""
    required = ("r_score", "f_score", "m_score", "last_updated")
    nulls = scores.where(F.col(key_col).isNull() | F.greatest(*[F.col(c).isNull() for c in required]))
    nulls = nulls.select(F.col(key_col), F.lit("null value").alias("reason"))
    dups = (scores.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select(key_col, F.lit("duplicate key").alias("reason")))
    return nulls.unionByName(dups)
