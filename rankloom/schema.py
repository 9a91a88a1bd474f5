"""Schemas of the panel tables and entry checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ("open", "high", "low", "close", "volume")

PANEL = T.StructType(
    [T.StructField("kdcode", T.StringType()), T.StructField("dt", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)
SCORES = T.StructType(
    [
        T.StructField("kdcode", T.StringType()),
        T.StructField("dt", T.DateType()),
        T.StructField("score", T.DoubleType()),
    ]
)
REGIME_REQUIRED = (
    "regime_market",
    "regime_yield_curve",
    "regime_oil",
    "regime_copper",
    "regime_stock_bond_corr",
)
REGIME_OPTIONAL = ("regime_monetary_policy", "regime_volatility")
REGIME_VARIABLES = REGIME_REQUIRED + REGIME_OPTIONAL


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_double(c: Column | str) -> Column:
    """A number, or NULL for text that is no number, NaN and infinities."""
    x = F.col(c) if isinstance(c, str) else c
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def safe_div(a: Column, b: Column) -> Column:
    """Division that gives NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a, b)
