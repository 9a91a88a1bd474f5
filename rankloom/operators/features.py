"""Row, price, volume, volatility and market-wide features.

All per-entity windows share one partitioning and order, so a chain of them needs one shuffle and
one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, gated, last_rows
from rankloom.operators.clean import asof_dates, join_series
from rankloom.schema import safe_div
from rankloom.sources.macro import date_order

EPS = 1e-8
YEAR_ROOT = 252**0.5
CREDIT_FEATURES = (
    "ig_spread", "hy_spread", "ig_spread_change", "hy_spread_change",
    "ig_spread_zscore", "hy_spread_zscore", "credit_spread_diff",
)
VIX_FEATURES = ("vix", "vix_change", "vix_regime")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (least and greatest skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def daily_return(close: str = "close") -> Column:
    """F4. Close over the entity's previous close."""
    return safe_div(F.col(close), F.lag(close).over(by_entity())) - 1


def add_turnover(df: DataFrame) -> DataFrame:
    """F1. close x volume unless the panel has it."""
    return df if "turnover" in df.columns else df.withColumn("turnover", F.col("close") * F.col("volume"))


def add_price_features(df: DataFrame) -> DataFrame:
    """F2. Range, body, overnight and intraday return."""
    rng = F.col("high") - F.col("low")
    zero = F.lit(0.0)
    return df.select(
        "*",
        safe_div(rng, F.col("close")).alias("daily_range"),
        (F.abs(F.col("close") - F.col("open")) / (rng + EPS)).alias("body_ratio"),
        F.coalesce(safe_div(F.col("open"), F.lag("close").over(by_entity())) - 1, zero).alias("overnight_return"),
        F.coalesce(safe_div(F.col("close"), F.col("open")) - 1, zero).alias("intraday_return"),
    )


def add_volume_features(df: DataFrame, window: int = 20) -> DataFrame:
    """F3. Moving average of volume, its ratio and dollar volume."""
    ma = F.avg("volume").over(last_rows(by_entity(), window))
    return df.select(
        "*",
        ma.alias(f"volume_ma{window}"),
        F.coalesce(F.col("volume") / (ma + EPS), F.lit(1.0)).alias("volume_ratio"),
        (F.col("close") * F.col("volume")).alias("dollar_volume"),
    )


def add_volatility_features(df: DataFrame, short: int = 5, long: int = 21) -> DataFrame:
    """F15. Realised volatility and its ratio.

    Gaps take the entity's median over the whole sample (which looks ahead, as published), 0.2 when
    there is none.
    """
    w = by_entity()
    out = df.withColumn("_ret", daily_return())
    cols = {f"volatility_{n}d": n for n in (short, long)}
    for c, n in cols.items():
        out = out.withColumn(c, gated(F.stddev_samp("_ret"), F.col("_ret"), last_rows(w, n), n) * YEAR_ROOT)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.median(c).over(Window.partitionBy("kdcode")), F.lit(0.2)))
    s, l = (F.col(c) for c in cols)
    return out.withColumn("vol_ratio", clip(s / (l + EPS), 0.1, 10.0)).drop("_ret")


def add_rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """F16. Relative strength index; the entity's first row counts as no gain and no loss."""
    w = by_entity()
    diff = F.col("close") - F.lag("close").over(w)
    out = df.select(
        "*",
        F.when(diff > 0, diff).otherwise(0.0).alias("_gain"),
        F.when(diff < 0, -diff).otherwise(0.0).alias("_loss"),
    )
    frame = last_rows(w, period)
    rs = gated(F.avg("_gain"), F.col("_gain"), frame, period) / (
        gated(F.avg("_loss"), F.col("_loss"), frame, period) + EPS
    )
    rsi = 100 - 100 / (1 + rs)
    return out.select(
        *df.columns,
        F.coalesce(rsi, F.lit(50.0)).alias(f"rsi_{period}"),
        F.coalesce((rsi - 50) / 50, F.lit(0.0)).alias("rsi_normalized"),
    )


def add_moving_average_features(df: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """F17. Distance to two moving averages and their cross."""
    w = by_entity()
    s, l = (F.avg("close").over(last_rows(w, n)) for n in (short, long))
    return df.select(
        "*",
        safe_div(F.col("close") - s, s).alias(f"dist_ma{short}"),
        safe_div(F.col("close") - l, l).alias(f"dist_ma{long}"),
        (s > l).cast("double").alias("ma_cross"),
    )


def vix_series(series: DataFrame, window: int = 10) -> DataFrame:
    """F18. (dt, vix, vix_change, vix_regime) of a market-wide series; one row per date."""
    w = date_order()
    return series.select(
        "dt",
        "vix",
        F.coalesce(safe_div(F.col("vix"), F.lag("vix").over(w)) - 1, F.lit(0.0)).alias("vix_change"),
        (F.col("vix") > F.avg("vix").over(last_rows(w, window))).cast("double").alias("vix_regime"),
    )


def add_vix_features(df: DataFrame, series: DataFrame, window: int = 10) -> DataFrame:
    """F18. The level is carried to later dates, its change and regime belong to their own date."""
    v = vix_series(series, window)
    level = asof_dates(df, v.where(F.col("vix").isNotNull()).select("dt", "vix"))
    out = join_series(level, v.select("dt", "vix_change", "vix_regime"))
    return out.select(
        *df.columns,
        F.coalesce("vix", F.lit(20.0)).alias("vix"),
        F.coalesce("vix_change", F.lit(0.0)).alias("vix_change"),
        F.coalesce("vix_regime", F.lit(0.0)).alias("vix_regime"),
    )


def credit_series(series: DataFrame, window: int = 63) -> DataFrame:
    """F19. Changes, rolling z-scores and difference of the two spreads; one row per date."""
    w = date_order()
    frame = last_rows(w, window)

    def z(c: str) -> Column:
        raw = (F.col(c) - F.avg(c).over(frame)) / (F.stddev_samp(c).over(frame) + EPS)
        return clip(F.coalesce(raw, F.lit(0.0)), -3.0, 3.0)

    return series.select(
        "dt",
        "ig_spread",
        "hy_spread",
        *[
            F.coalesce(safe_div(F.col(c), F.lag(c).over(w)) - 1, F.lit(0.0)).alias(f"{c}_change")
            for c in ("ig_spread", "hy_spread")
        ],
        *[z(c).alias(f"{c}_zscore") for c in ("ig_spread", "hy_spread")],
        (F.col("hy_spread") - F.col("ig_spread")).alias("credit_spread_diff"),
    )


def add_credit_features(df: DataFrame, series: DataFrame, window: int = 63) -> DataFrame:
    """F19. Credit columns carried forward by date, 0 before the series starts."""
    c = credit_series(series, window)
    out = asof_dates(df, c)
    return out.select(*df.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in CREDIT_FEATURES])
