"""Market-wide series: shaping, assembly and fallbacks.

These tables have one row per date, or per (series_id, dt), so the ordered windows below are bounded
by the calendar. Anything larger is aggregated to that size first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, fill_both, fill_forward, gated, last_rows
from rankloom.functions.groups import keep_last
from rankloom.schema import (
    REGIME_OPTIONAL,
    REGIME_REQUIRED,
    REGIME_VARIABLES,
    clean_double,
    require_columns,
    safe_div,
)


def date_order():
    return Window.partitionBy(F.lit(0)).orderBy("dt")


def shape_series(raw: DataFrame, lag_rows: int, start: str, end: str) -> DataFrame:
    """S3. Text values to numbers, gaps filled forward then backward, lagged by rows, clipped."""
    w = by_entity("series_id")
    df = raw.select("series_id", "dt", clean_double("value").alias("value"))
    df = df.withColumn("value", fill_both(F.col("value"), w))
    if lag_rows > 0:
        df = df.withColumn("value", F.lag("value", lag_rows).over(w))
    return df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def credit_pair(ig: DataFrame, hy: DataFrame, start: str, end: str) -> DataFrame:
    """S4. Both spreads on the union of their dates, filled, lagged by one row and clipped."""
    w = date_order()
    pair = ig.select("dt", F.col("value").alias("ig_spread")).join(
        hy.select("dt", F.col("value").alias("hy_spread")), "dt", "full_outer"
    )
    cols = ("ig_spread", "hy_spread")
    pair = pair.select("dt", *[fill_forward(F.col(c), w).alias(c) for c in cols]).dropna("all", subset=list(cols))
    back = w.rowsBetween(0, Window.unboundedFollowing)
    pair = pair.select("dt", *[F.first(c, ignorenulls=True).over(back).alias(c) for c in cols])
    pair = pair.select("dt", *[F.lag(c).over(w).alias(c) for c in cols])
    return pair.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).dropna(
        "all", subset=list(cols)
    )


def regime_file(raw: DataFrame, seq: str, lag_rows: int = 0) -> DataFrame:
    """S5. Regime inputs from a file: last row per date, optional columns added, lagged, filled."""
    require_columns(raw, ("dt", *REGIME_REQUIRED))
    df = keep_last(raw, ["dt"], seq).drop(seq)
    for c in REGIME_OPTIONAL:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    w = date_order()
    df = df.select("dt", *[clean_double(c).alias(c) for c in REGIME_VARIABLES])
    if lag_rows > 0:
        df = df.select("dt", *[F.lag(c, lag_rows).over(w).alias(c) for c in REGIME_VARIABLES])
    return df.select("dt", *[fill_both(F.col(c), w).alias(c) for c in REGIME_VARIABLES])


ASSEMBLY_SERIES = ("market", "copper", "yield_10y", "yield_3m", "oil", "vix")


def assemble_regime(series: DataFrame, corr_rows: int = 63, corr_min: int = 21) -> DataFrame:
    """S6. Long (series_id, dt, value) to the regime inputs; one pivot replaces five outer joins."""
    w = date_order()
    base = series.groupBy("dt").pivot("series_id", list(ASSEMBLY_SERIES)).agg(F.max("value"))
    base = base.select(
        "*",
        (safe_div(F.col("market"), F.lag("market").over(w)) - 1).alias("_r"),
        (F.col("yield_10y") - F.lag("yield_10y").over(w)).alias("_dy"),
    )
    frame = last_rows(w, corr_rows)
    both = F.when(F.col("_r").isNotNull() & F.col("_dy").isNotNull(), F.lit(1))
    raw = base.select(
        "dt",
        F.col("market").alias("regime_market"),
        (F.col("yield_10y") - F.col("yield_3m")).alias("regime_yield_curve"),
        F.col("oil").alias("regime_oil"),
        F.col("copper").alias("regime_copper"),
        gated(F.corr("_r", "_dy"), both, frame, corr_min).alias("regime_stock_bond_corr"),
        F.col("yield_3m").alias("regime_monetary_policy"),
        F.col("vix").alias("regime_volatility"),
    )
    return raw.select("dt", *[fill_both(F.col(c), w).alias(c) for c in REGIME_VARIABLES])


def first_available(candidates: DataFrame) -> DataFrame:
    """S7. The whole series of the best source: (series_id, priority, dt, value), priority 1 first.

    A source counts only when it has values; the choice is one small row per series.
    """
    chosen = (
        candidates.where(F.col("value").isNotNull())
        .groupBy("series_id")
        .agg(F.min("priority").alias("priority"))
    )
    return candidates.join(chosen, ["series_id", "priority"]).select("series_id", "priority", "dt", "value")


def missing_series(chosen: DataFrame, required: Sequence[str]) -> DataFrame:
    """S7. Required series without any row; a caller fails when this is not empty."""
    want = chosen.sparkSession.createDataFrame([(s,) for s in required], "series_id string")
    return want.join(chosen.select("series_id").distinct(), "series_id", "left_anti")


def export_series(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """S8. Partial export: series side by side on the union of their dates, last row per date."""
    last = keep_last(series, ["series_id", "dt"], "seq").drop("seq")
    return last.groupBy("dt").pivot("series_id", list(names)).agg(F.max("value"))


def export_counts(series: DataFrame) -> DataFrame:
    """S8. Rows per exported series."""
    last = keep_last(series, ["series_id", "dt"], "seq")
    return last.groupBy("series_id").agg(F.count("value").alias("n_rows"))
