"""Regime similarity: macro analogues on monthly states.

Everything here has one row per month, or per pair of months, so it is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import gated, last_rows
from rankloom.operators.clean import asof_dates
from rankloom.schema import REGIME_VARIABLES, safe_div


@dataclass(frozen=True)
class Regime:
    """Settings; windows count months."""

    change: int = 12
    window: int = 120
    clip_z: float = 3.0
    exclusion: int = 1
    quantile: float = 0.2
    min_history: int = 24
    subsequent: bool = True
    horizons: tuple[int, ...] = (1, 3)

    def __post_init__(self) -> None:
        if min(self.change, self.window, self.min_history) < 1 or not 0 < self.quantile < 0.5:
            raise ValueError("windows must be positive and quantile in (0, 0.5)")
        if self.subsequent and self.exclusion < 1:
            raise ValueError("subsequent returns need exclusion >= 1")
        object.__setattr__(self, "horizons", normal_horizons(self.horizons))


def normal_horizons(horizons: Sequence[int] | None) -> tuple[int, ...]:
    """G7. Positive whole months without repeats, order kept; (1, 3) when none are given."""
    chosen = tuple(dict.fromkeys(horizons or (1, 3)))
    if any(isinstance(h, bool) or not isinstance(h, int) or h < 1 for h in chosen):
        raise ValueError("horizons must be positive whole numbers")
    return chosen


def regime_columns(subsequent: bool = True, horizons: Sequence[int] | None = None) -> list[str]:
    """G7. Names of the regime features in order."""
    base = [
        "regime_global_score", "regime_similarity_q20_mean", "regime_dissimilarity_q80_mean", "regime_similarity_spread",
    ]
    if not subsequent:
        return base
    h = normal_horizons(horizons)
    names = [f"regime_similar_subsequent_return_{n}m" for n in h]
    return base + names + (["regime_subsequent_return_spread_1m"] if 1 in h else [])


def month_order() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("dt")


def month_ends(inputs: DataFrame) -> DataFrame:
    """G1. Last non-NULL value per variable and calendar month, dated at the month's end."""
    have = [c for c in REGIME_VARIABLES if c in inputs.columns]
    out = inputs.groupBy(F.last_day("dt").alias("month")).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("dt"))).alias(c) for c in have]
    )
    return out.withColumnRenamed("month", "dt").dropna("all", subset=have)


def monthly_states(monthly: DataFrame, p: Regime) -> DataFrame:
    """G2. Clipped rolling z-scores of the change over ``change`` kept months."""
    have = [c for c in REGIME_VARIABLES if c in monthly.columns]
    w = month_order()
    least = max(p.min_history, p.change + 1)
    change = monthly.select("dt", *[(F.col(c) - F.lag(c, p.change).over(w)).alias(c) for c in have])
    frame = last_rows(w, p.window)

    def z(c: str):
        x = F.col(c)
        raw = (x - gated(F.avg(x), x, frame, least)) / (gated(F.stddev_samp(x), x, frame, least) + 1e-8)
        return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(-p.clip_z)), F.lit(p.clip_z)))

    return change.select("dt", *[z(c).alias(c) for c in have])


def month_distances(states: DataFrame, p: Regime) -> DataFrame:
    """G3. (dt, idx, past, distance) of each month to every month before ``idx - exclusion``.

    The pairs are the result; each month unfolds its own history array, so there is no join.
    """
    have = [c for c in REGIME_VARIABLES if c in states.columns]
    w = month_order()
    s = states.select("dt", (F.row_number().over(w) - 1).alias("idx"), F.array(*have).alias("z"))
    past = s.withColumn(
        "history",
        F.collect_list(F.struct("idx", "z")).over(w.rowsBetween(Window.unboundedPreceding, -(p.exclusion + 1))),
    )
    pairs = past.select("dt", "idx", "z", F.explode("history").alias("h")).select(
        "dt", "idx", F.col("h.idx").alias("past"), F.zip_with("z", "h.z", lambda a, b: (a - b) * (a - b)).alias("sq")
    )
    known = F.filter("sq", lambda v: v.isNotNull())
    return (
        pairs.withColumn("sq", known)
        .where(F.size("sq") > 0)
        .select("dt", "idx", "past", F.sqrt(F.aggregate("sq", F.lit(0.0), lambda a, v: a + v)).alias("distance"))
    )


def forward_market(monthly: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """G5. (past, fwd_<h>): market return after each month."""
    w = month_order()
    m = F.col("regime_market")
    return monthly.select(
        (F.row_number().over(w) - 1).alias("past"),
        *[(safe_div(F.lead(m, h).over(w), m) - 1).alias(f"fwd_{h}") for h in horizons],
    )


def regime_features(inputs: DataFrame, p: Regime = Regime()) -> DataFrame:
    """G4, G5. Monthly features; NULL until ``min_history`` analogues exist."""
    monthly = month_ends(inputs)
    d = month_distances(monthly_states(monthly, p), p)
    month = Window.partitionBy("dt")
    n = F.count("*").over(month)
    d = d.join(forward_market(monthly, p.horizons), "past")
    ranked = d.select(
        "*",
        F.row_number().over(month.orderBy("distance", "past")).alias("pos"),
        n.alias("n"),
        F.greatest(F.lit(1), F.floor(n * F.lit(p.quantile))).alias("q"),
    ).where(F.col("n") >= p.min_history)
    near, far = F.col("pos") <= F.col("q"), F.col("pos") > F.col("n") - F.col("q")

    def mean(cond, c):
        return F.avg(F.when(cond, F.col(c)))

    aggs = [
        F.avg("distance").alias("regime_global_score"),
        mean(near, "distance").alias("regime_similarity_q20_mean"),
        mean(far, "distance").alias("regime_dissimilarity_q80_mean"),
        (mean(far, "distance") - mean(near, "distance")).alias("regime_similarity_spread"),
    ]
    if p.subsequent:
        aggs += [mean(near, f"fwd_{h}").alias(f"regime_similar_subsequent_return_{h}m") for h in p.horizons]
        if 1 in p.horizons:
            aggs.append((mean(near, "fwd_1") - mean(far, "fwd_1")).alias("regime_subsequent_return_spread_1m"))
    scored = ranked.groupBy("dt").agg(*aggs)
    return monthly.select("dt").join(scored, "dt", "left").select("dt", *regime_columns(p.subsequent, p.horizons))


def add_regime_features(df: DataFrame, inputs: DataFrame, p: Regime = Regime()) -> DataFrame:
    """G6. Features of the last month end on or before each date, the last known value carried on, then 0.

    Gaps are closed on the monthly table, which has the same effect as carrying values down the
    dates and avoids sorting the panel.
    """
    cols = regime_columns(p.subsequent, p.horizons)
    w = month_order().rowsBetween(Window.unboundedPreceding, 0)
    monthly = regime_features(inputs, p).select("dt", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    out = asof_dates(df, monthly)
    return out.select(*df.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
