"""F20. Feature sets: which columns a configuration asks for, and the chain that adds them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.groups import calendar, join_dates
from rankloom.operators import features as fe
from rankloom.operators import momentum as mo
from rankloom.operators.regime import Regime, add_regime_features, regime_columns
from rankloom.session import stable

# Column names of each feature family.
BASE = ("close", "open", "high", "low", "volume", "turnover")
MOMENTUM = (
    "slow_momentum", "fast_momentum", "slow_signal", "fast_signal", "momentum_blend",
    "cycle_bull", "cycle_correction", "cycle_bear",
)
WEEKLY = ("weekly_momentum", "weekly_signal")
VOLATILITY = ("volatility_5d", "volatility_21d", "vol_ratio")
ENCODINGS = {
    "binary": mo.add_momentum_binary,
    "continuous": mo.add_momentum_continuous,
    "buffered": mo.add_momentum_buffered,
}


@dataclass(frozen=True)
class FeatureConfig:
    base: bool = True
    price: bool = False
    volume: bool = False
    momentum: bool = True
    weekly: bool = True
    encoding: str = "binary"
    volatility: bool = False
    vix: bool = False
    credit: bool = False
    regime: bool = False
    rsi: bool = False
    moving_averages: bool = False
    extra: tuple[str, ...] = ()
    strict: bool = False
    momentum_settings: mo.Momentum = field(default_factory=mo.Momentum)
    regime_settings: Regime = field(default_factory=Regime)

    def __post_init__(self) -> None:
        if self.encoding not in ENCODINGS:
            raise ValueError(f"encoding must be one of {sorted(ENCODINGS)}")


def feature_columns(c: FeatureConfig) -> list[str]:
    """Ordered column names without repeats."""
    names: list[str] = []
    if c.base:
        names += BASE
    if c.price:
        names += ("daily_range", "body_ratio", "overnight_return", "intraday_return")
    if c.volume:
        names += ("volume_ma20", "volume_ratio", "dollar_volume")
    if c.momentum:
        names += MOMENTUM
        if c.weekly:
            names += WEEKLY
        if c.encoding == "buffered":
            names += ("trade_signal",)
    if c.volatility:
        names += VOLATILITY
    if c.vix:
        names += fe.VIX_FEATURES
    if c.credit:
        names += fe.CREDIT_FEATURES
    if c.rsi:
        names += ("rsi_14", "rsi_normalized")
    if c.moving_averages:
        names += ("dist_ma50", "dist_ma200", "ma_cross")
    if c.regime:
        names += regime_columns(c.regime_settings.subsequent, c.regime_settings.horizons)
    return list(dict.fromkeys([*names, *c.extra]))


def _missing(df: DataFrame, name: str, columns: Sequence[str], strict: bool) -> DataFrame:
    if strict:
        raise ValueError(f"{name} features are on but their series is missing")
    return df.select("*", *[F.lit(0.0).alias(c) for c in columns])


def market_features(
    df: DataFrame, c: FeatureConfig, vix: DataFrame | None, credit: DataFrame | None, regime: DataFrame | None
) -> DataFrame:
    """The configured market-wide families on the panel's dates: one row per date."""
    out = stable(calendar(df))
    if c.vix:
        out = _missing(out, "vix", fe.VIX_FEATURES, c.strict) if vix is None else fe.add_vix_features(out, vix)
    if c.credit:
        out = _missing(out, "credit", fe.CREDIT_FEATURES, c.strict) if credit is None else fe.add_credit_features(out, credit)
    if c.regime:
        cols = regime_columns(c.regime_settings.subsequent, c.regime_settings.horizons)
        out = _missing(out, "regime", cols, c.strict) if regime is None else add_regime_features(out, regime, c.regime_settings)
    return stable(out)


def add_features(
    df: DataFrame,
    c: FeatureConfig,
    vix: DataFrame | None = None,
    credit: DataFrame | None = None,
    regime: DataFrame | None = None,
) -> DataFrame:
    """Add every configured family; a missing series gives zero columns, or raises when strict.

    Per-entity families share one shuffle by entity. The market-wide ones are computed on the dates
    alone and joined once.
    """
    out = fe.add_turnover(df)
    if c.price:
        out = fe.add_price_features(out)
    if c.volume:
        out = fe.add_volume_features(out)
    if c.volatility:
        out = fe.add_volatility_features(out)
    if c.rsi:
        out = fe.add_rsi(out)
    if c.moving_averages:
        out = fe.add_moving_average_features(out)
    if c.momentum:
        out = ENCODINGS[c.encoding](out, c.momentum_settings)
        if not c.weekly:
            out = out.drop(*WEEKLY)
    if c.vix or c.credit or c.regime:
        out = join_dates(out, market_features(df, c, vix, credit, regime))
    return out.select("kdcode", "dt", *feature_columns(c))
