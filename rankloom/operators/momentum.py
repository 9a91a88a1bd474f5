"""Momentum features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, gated, last_rows, rows_before
from rankloom.functions.groups import attach, join_dates
from rankloom.functions.ranking import groups_fit, percent_ranks, percent_ranks_of_groups
from rankloom.operators.features import EPS, clip, daily_return
from rankloom.schema import safe_div
from rankloom.session import stable

STATES = ("Bu", "Co", "Be", "Re")
TINY = 1e-12


@dataclass(frozen=True)
class Momentum:
    """Windows in rows and blend settings; ``lookback`` 0 means all history."""

    fast: int = 21
    slow: int = 252
    weekly: int = 5
    blend: str = "static"
    fast_weight: float = 0.5
    correction_weight: float = 0.15
    rebound_weight: float = 0.70
    lookback: int = 0
    min_history: int = 252
    min_state_rows: int = 3
    buffer_low: float = 0.1
    buffer_high: float = 0.9

    def __post_init__(self) -> None:
        if self.blend not in ("static", "dynamic"):
            raise ValueError("blend must be static or dynamic")
        for n in ("fast_weight", "correction_weight", "rebound_weight"):
            if not 0.0 <= getattr(self, n) <= 1.0:
                raise ValueError(f"{n} must be in [0, 1]")
        if min(self.fast, self.slow, self.weekly, self.min_history, self.min_state_rows) < 1 or self.lookback < 0:
            raise ValueError("windows must be positive, lookback not negative")
        if not 0.0 <= self.buffer_low < self.buffer_high <= 1.0:
            raise ValueError("0 <= buffer_low < buffer_high <= 1")


def add_raw_momentum(df: DataFrame, m: Momentum) -> DataFrame:
    """F5. Rolling sums of daily returns; NULL until the window is full."""
    w = by_entity()
    out = df.withColumn("_ret", daily_return())
    for name, n in (("fast", m.fast), ("slow", m.slow), ("weekly", m.weekly)):
        out = out.withColumn(f"{name}_momentum", gated(F.sum("_ret"), F.col("_ret"), last_rows(w, n), n))
    return out


def position(c: Column) -> Column:
    """F6. +1 for momentum >= 0, -1 below, 0 without history."""
    return F.when(c >= 0, 1.0).when(c < 0, -1.0).otherwise(0.0)


def market_state(slow: Column, fast: Column) -> Column:
    """F7. Bull, correction, bear, rebound; NULL when a position is 0."""
    return (
        F.when((slow == 1) & (fast == 1), "Bu")
        .when((slow == 1) & (fast == -1), "Co")
        .when((slow == -1) & (fast == -1), "Be")
        .when((slow == -1) & (fast == 1), "Re")
    )


def cycle_columns(slow: Column, fast: Column) -> list[Column]:
    """F8. One-hot bull, correction and bear."""
    state = market_state(slow, fast)
    return [
        F.coalesce((state == s).cast("double"), F.lit(0.0)).alias(n)
        for s, n in (("Bu", "cycle_bull"), ("Co", "cycle_correction"), ("Be", "cycle_bear"))
    ]


def blend_signals(slow: Column, fast: Column, weight: Column, slow_pos: Column, fast_pos: Column) -> Column:
    """F9. Weighted signals, 0 while a position is undefined."""
    return F.when((slow_pos == 0) | (fast_pos == 0), 0.0).otherwise((1 - weight) * slow + weight * fast)


def history_sum(x: Column, lookback: int) -> Column:
    """F10. Sum over the rows before the current one."""
    return F.coalesce(F.sum(x).over(rows_before(by_entity(), lookback)), F.lit(0.0))


def add_blend_weight(df: DataFrame, m: Momentum) -> DataFrame:
    """F11. Fast weight of each row from ``_slow_pos``, ``_fast_pos`` and ``_ret``.

    Moments per state pair a state with the next return. The frame ends one row back, so the last
    pair used was complete at the current row: nothing later is read.
    """
    if m.blend == "static":
        return df.withColumn("_weight", F.lit(m.fast_weight))
    nxt = F.lead("_ret").over(by_entity())
    state = market_state(F.col("_slow_pos"), F.col("_fast_pos"))
    d = df.withColumn("_state", state).withColumn("_next", F.when(state.isNotNull(), nxt))
    pair = F.col("_next").isNotNull()
    sums = [history_sum(F.when(pair, 1.0), m.lookback).alias("_n")]
    for s in STATES:
        here = pair & (F.col("_state") == s)
        sums += [
            history_sum(F.when(here, 1.0), m.lookback).alias(f"_n_{s}"),
            history_sum(F.when(here, F.col("_next")), m.lookback).alias(f"_s_{s}"),
            history_sum(F.when(here, F.col("_next") * F.col("_next")), m.lookback).alias(f"_q_{s}"),
        ]
    d = d.select("*", *sums)

    def mean(s: str) -> Column:
        return safe_div(F.col(f"_s_{s}"), F.col(f"_n_{s}"))

    def second(s: str) -> Column:
        return safe_div(F.col(f"_q_{s}"), F.col(f"_n_{s}"))

    def share(s: str) -> Column:
        return safe_div(F.col(f"_n_{s}"), F.col("_n"))

    slope = mean("Bu") * share("Bu") - mean("Be") * share("Be")

    def enough(s: str) -> Column:
        ok = F.col("_n") >= m.min_history
        for name in ("Bu", "Be", s):
            ok = ok & (F.col(f"_n_{name}") >= m.min_state_rows)
        return ok & (slope > TINY) & (second(s) > TINY)

    def tilt(held: str, s: str) -> Column:
        return safe_div(second(held) * share(held), slope) * safe_div(mean(s), second(s))

    a_co = F.when(enough("Co"), 0.5 * (1 - tilt("Bu", "Co"))).otherwise(m.correction_weight)
    a_re = F.when(enough("Re"), 0.5 * (1 + tilt("Be", "Re"))).otherwise(m.rebound_weight)
    weight = (
        F.when(F.col("_state") == "Co", clip(a_co, 0.0, 1.0))
        .when(F.col("_state") == "Re", clip(a_re, 0.0, 1.0))
        .otherwise(0.5)
    )
    return d.withColumn("_weight", weight).drop(
        "_state", "_next", "_n", *[f"_{k}_{s}" for k in "nsq" for s in STATES]
    )


def _prepared(df: DataFrame, m: Momentum) -> DataFrame:
    """Raw momentum, positions and blend weight; then momentum gaps become 0."""
    out = add_raw_momentum(df, m)
    out = out.select(
        "*",
        position(F.col("slow_momentum")).alias("_slow_pos"),
        position(F.col("fast_momentum")).alias("_fast_pos"),
        position(F.col("weekly_momentum")).alias("_weekly_pos"),
    )
    out = add_blend_weight(out, m)
    return out.fillna(0.0, subset=["slow_momentum", "fast_momentum", "weekly_momentum"])


def _finish(out: DataFrame, columns: list[str], slow: Column, fast: Column, weekly: Column, trade: bool = False) -> DataFrame:
    sp, fp = F.col("_slow_pos"), F.col("_fast_pos")
    done = out.select(
        *columns,
        "slow_momentum",
        "fast_momentum",
        "weekly_momentum",
        slow.alias("slow_signal"),
        fast.alias("fast_signal"),
        weekly.alias("weekly_signal"),
        blend_signals(slow, fast, F.col("_weight"), sp, fp).alias("momentum_blend"),
        *cycle_columns(sp, fp),
    )
    if trade:
        b = F.col("momentum_blend")
        done = done.withColumn("trade_signal", F.when(F.abs(b) < 0.2, 0.0).otherwise(F.signum(b)))
    return done


def add_momentum_binary(df: DataFrame, m: Momentum = Momentum()) -> DataFrame:
    """F12. Signals are the positions."""
    return _finish(_prepared(df, m), df.columns, F.col("_slow_pos"), F.col("_fast_pos"), F.col("_weekly_pos"))


def add_momentum_continuous(df: DataFrame, m: Momentum = Momentum()) -> DataFrame:
    """F13. Signals are clipped z-scores of the date.

    The weekly position is taken after the gaps were filled, so it is never 0.
    """
    out = stable(_prepared(df, m))  # read for the statistics and for the rows
    names = ("slow", "fast", "weekly")
    stats = {f"_{k}_{n}": f(f"{n}_momentum") for n in names for k, f in (("mu", F.avg), ("sd", F.stddev_samp))}
    out = attach(out, ["dt"], **stats)

    def z(n: str) -> Column:
        raw = (F.col(f"{n}_momentum") - F.col(f"_mu_{n}")) / (F.col(f"_sd_{n}") + EPS)
        return F.coalesce(clip(raw, -3.0, 3.0), F.lit(0.0))

    slow = F.when(F.col("_slow_pos") == 0, 0.0).otherwise(z("slow"))
    fast = F.when(F.col("_fast_pos") == 0, 0.0).otherwise(z("fast"))
    return _finish(out, df.columns, slow, fast, z("weekly"))


def add_momentum_buffered(df: DataFrame, m: Momentum = Momentum()) -> DataFrame:
    """F14. Signals are scaled rank percentiles of the date with a dead zone at both ends."""
    names = ("slow", "fast", "weekly")
    columns = [f"{n}_momentum" for n in names]
    # A date without any non-zero value gives no signal at all.
    some = {f"_any_{n}": F.max(F.col(f"{n}_momentum") != 0) for n in names}
    if groups_fit(df, ["dt"]):
        out = percent_ranks_of_groups(_prepared(df, m), ["dt"], columns)
        out = out.withColumns({k: a.over(Window.partitionBy("dt")) for k, a in some.items()})
    else:
        base = stable(_prepared(df, m))  # read for the ranks, the dates and the rows
        out = join_dates(percent_ranks(base, ["dt"], columns), base.groupBy("dt").agg(*[a.alias(k) for k, a in some.items()]))

    def signal(n: str) -> Column:
        p = F.col(f"{n}_momentum_pct")
        inside = F.col(f"_any_{n}") & (p >= m.buffer_low) & (p <= m.buffer_high)
        return F.when(inside, (p - m.buffer_low) / (m.buffer_high - m.buffer_low) * 2 - 1).otherwise(0.0)

    slow = F.when(F.col("_slow_pos") == 0, 0.0).otherwise(signal("slow"))
    fast = F.when(F.col("_fast_pos") == 0, 0.0).otherwise(signal("fast"))
    return _finish(out, df.columns, slow, fast, signal("weekly"), trade=True)
