"""Features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, last_rows
from rankloom.operators import features as fe
from rankloom.operators import momentum as mo
from rankloom.operators.feature_sets import FeatureConfig, add_features
from rankloom.plans import testdata as td
from rankloom.plans import q_regime  # noqa: F401  (its check SQL is reused)
from rankloom.plans.registry import ORACLES, SHARED, check_sql, query, r, rounded, share

W = "(PARTITION BY kdcode ORDER BY dt)"


def rows(n: int) -> str:
    return f"(PARTITION BY kdcode ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(agg: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {rows(n)} >= {n} THEN {agg} OVER {rows(n)} END"


def bars(spark, sf, *extra):
    return td.bars_d(spark, sf)


@query("f1_turnover", check_sql("bars_d", f"SELECT kdcode, dt, {r('close * volume', 7)} AS turnover FROM bars_d"))
def f1(spark, sf):
    return rounded(fe.add_turnover(bars(spark, sf)).select("kdcode", "dt", "turnover"), "turnover", digits=7)


@query(
    "f2_price_features",
    check_sql(
        "bars_d",
        f"""SELECT kdcode, dt, {r('(high - low) / close')} AS daily_range, {r('abs(close - open) / (high - low + 1e-8)')} AS body_ratio,
    {r(f'coalesce(open / lag(close) OVER {W} - 1, 0)')} AS overnight_return, {r('close / open - 1')} AS intraday_return FROM bars_d""",
    ),
)
def f2(spark, sf):
    cols = ("daily_range", "body_ratio", "overnight_return", "intraday_return")
    return rounded(fe.add_price_features(bars(spark, sf)).select("kdcode", "dt", *cols), *cols)


@query(
    "f3_volume_features",
    check_sql(
        "bars_d",
        f"""SELECT kdcode, dt, {r(f'avg(volume) OVER {rows(20)}')} AS volume_ma20, {r(f'volume / (avg(volume) OVER {rows(20)} + 1e-8)')} AS volume_ratio,
    {r('close * volume', 7)} AS dollar_volume FROM bars_d""",
    ),
)
def f3(spark, sf):
    df = fe.add_volume_features(bars(spark, sf)).select("kdcode", "dt", "volume_ma20", "volume_ratio", "dollar_volume")
    return rounded(rounded(df, "volume_ma20", "volume_ratio"), "dollar_volume", digits=7)


share("daily_ret", f"SELECT kdcode, dt, close, close / lag(close) OVER {W} - 1 AS ret FROM bars_d", "bars_d")


@query("f4_daily_return", check_sql("daily_ret", f"SELECT kdcode, dt, {r('ret')} AS ret FROM daily_ret"))
def f4(spark, sf):
    return rounded(bars(spark, sf).select("kdcode", "dt", fe.daily_return().alias("ret")), "ret")


def momentum_cte(name: str, fast: int, slow: int, weekly: int) -> None:
    share(
        f"mom_{name}",
        f"""SELECT kdcode, dt, ret, {gate('sum(ret)', 'ret', fast)} AS fast_momentum, {gate('sum(ret)', 'ret', slow)} AS slow_momentum,
        {gate('sum(ret)', 'ret', weekly)} AS weekly_momentum FROM daily_ret""",
        "daily_ret",
    )
    share(
        f"pos_{name}",
        "SELECT *, " + ", ".join(
            f"CASE WHEN {n}_momentum >= 0 THEN 1 WHEN {n}_momentum < 0 THEN -1 ELSE 0 END AS {n[0]}p" for n in ("slow", "fast", "weekly")
        ) + f" FROM mom_{name}",
        f"mom_{name}",
    )


momentum_cte("std", 21, 252, 5)
momentum_cte("dyn", 21, 126, 5)
DYN = mo.Momentum(slow=126, blend="dynamic", min_history=60)
STATE = "CASE WHEN sp = 1 AND fp = 1 THEN 'Bu' WHEN sp = 1 AND fp = -1 THEN 'Co' WHEN sp = -1 AND fp = -1 THEN 'Be' WHEN sp = -1 AND fp = 1 THEN 'Re' END"
MOMS = ("slow_momentum", "fast_momentum", "weekly_momentum")


@query(
    "f5_raw_momentum",
    check_sql("mom_std", "SELECT kdcode, dt, " + ", ".join(f"{r(c)} AS {c}" for c in MOMS) + " FROM mom_std"),
)
def f5(spark, sf):
    return rounded(mo.add_raw_momentum(bars(spark, sf), mo.Momentum()).select("kdcode", "dt", *MOMS), *MOMS)


def positions(spark, sf, m=mo.Momentum()):
    raw = mo.add_raw_momentum(bars(spark, sf), m)
    return raw.select(
        "kdcode", "dt", "_ret",
        mo.position(F.col("slow_momentum")).alias("_slow_pos"), mo.position(F.col("fast_momentum")).alias("_fast_pos"),
    )


@query("f6_positions", check_sql("pos_std", "SELECT kdcode, dt, sp::DOUBLE AS slow_position, fp::DOUBLE AS fast_position FROM pos_std"))
def f6(spark, sf):
    return positions(spark, sf).select(
        "kdcode", "dt", F.col("_slow_pos").alias("slow_position"), F.col("_fast_pos").alias("fast_position")
    )


@query("f7_market_state", check_sql("pos_std", f"SELECT kdcode, dt, {STATE} AS state FROM pos_std"))
def f7(spark, sf):
    return positions(spark, sf).select("kdcode", "dt", mo.market_state(F.col("_slow_pos"), F.col("_fast_pos")).alias("state"))


CYCLE = "(sp = 1 AND fp = 1)::INTEGER::DOUBLE AS cycle_bull, (sp = 1 AND fp = -1)::INTEGER::DOUBLE AS cycle_correction, (sp = -1 AND fp = -1)::INTEGER::DOUBLE AS cycle_bear"


@query("f8_cycle", check_sql("pos_std", f"SELECT kdcode, dt, {CYCLE} FROM pos_std"))
def f8(spark, sf):
    return positions(spark, sf).select("kdcode", "dt", *mo.cycle_columns(F.col("_slow_pos"), F.col("_fast_pos")))


@query(
    "f9_static_blend",
    check_sql("pos_std", f"SELECT kdcode, dt, {r('CASE WHEN sp = 0 OR fp = 0 THEN 0 ELSE 0.7 * sp + 0.3 * fp END')} AS momentum_blend FROM pos_std"),
)
def f9(spark, sf):
    s, f = F.col("_slow_pos"), F.col("_fast_pos")
    df = positions(spark, sf).select("kdcode", "dt", mo.blend_signals(s, f, F.lit(0.3), s, f).alias("momentum_blend"))
    return rounded(df, "momentum_blend")


PRIOR = "(PARTITION BY kdcode ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PRIOR20 = "(PARTITION BY kdcode ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query(
    "f10_history_sum",
    check_sql(
        "bars_d",
        f"SELECT kdcode, dt, {r(f'coalesce(sum(volume) OVER {PRIOR}, 0)')} AS all_before, {r(f'coalesce(sum(volume) OVER {PRIOR20}, 0)')} AS last_20_before FROM bars_d",
    ),
)
def f10(spark, sf):
    df = bars(spark, sf).select(
        "kdcode", "dt", mo.history_sum(F.col("volume"), 0).alias("all_before"), mo.history_sum(F.col("volume"), 20).alias("last_20_before")
    )
    return rounded(df, "all_before", "last_20_before")


def _moments() -> str:
    parts = [f"coalesce(sum(CASE WHEN nxt IS NOT NULL THEN 1 END) OVER {PRIOR}, 0)::DOUBLE AS n"]
    for s in mo.STATES:
        here = f"nxt IS NOT NULL AND state = '{s}'"
        parts += [
            f"coalesce(sum(CASE WHEN {here} THEN 1 END) OVER {PRIOR}, 0)::DOUBLE AS n_{s}",
            f"coalesce(sum(CASE WHEN {here} THEN nxt END) OVER {PRIOR}, 0) AS s_{s}",
            f"coalesce(sum(CASE WHEN {here} THEN nxt * nxt END) OVER {PRIOR}, 0) AS q_{s}",
        ]
    return ", ".join(parts)


share("dyn_state", f"SELECT *, {STATE} AS state, CASE WHEN {STATE} IS NOT NULL THEN lead(ret) OVER {W} END AS nxt FROM pos_dyn", "pos_dyn")
share("dyn_moments", f"SELECT *, {_moments()} FROM dyn_state", "dyn_state")
share("dyn_slope", "SELECT *, s_Bu / nullif(n_Bu, 0) * n_Bu / nullif(n, 0) - s_Be / nullif(n_Be, 0) * n_Be / nullif(n, 0) AS slope FROM dyn_moments", "dyn_moments")


def _weight(s: str, held: str, sign: str, fallback: float) -> str:
    ok = f"n >= 60 AND n_Bu >= 3 AND n_Be >= 3 AND n_{s} >= 3 AND slope > 1e-12 AND q_{s} / nullif(n_{s}, 0) > 1e-12"
    tilt = f"(q_{held} / nullif(n_{held}, 0) * n_{held} / nullif(n, 0)) / nullif(slope, 0) * ((s_{s} / nullif(n_{s}, 0)) / nullif(q_{s} / nullif(n_{s}, 0), 0))"
    return f"least(greatest(CASE WHEN {ok} THEN 0.5 * (1 {sign} {tilt}) ELSE {fallback} END, 0), 1)"


share(
    "dyn_weight",
    f"""SELECT *, (CASE state WHEN 'Co' THEN {_weight('Co', 'Bu', '-', 0.15)} WHEN 'Re' THEN {_weight('Re', 'Be', '+', 0.7)} ELSE 0.5 END)::DOUBLE AS weight
    FROM dyn_slope""",
    "dyn_slope",
)


@query("f11_dynamic_weight", check_sql("dyn_weight", f"SELECT kdcode, dt, {r('weight', 5)} AS fast_weight FROM dyn_weight"))
def f11(spark, sf):
    df = mo.add_blend_weight(positions(spark, sf, DYN), DYN)
    return rounded(df.select("kdcode", "dt", F.col("_weight").alias("fast_weight")), "fast_weight", digits=5)


SIGNALS = ("slow_signal", "fast_signal", "weekly_signal", "momentum_blend")
CYCLES = ("cycle_bull", "cycle_correction", "cycle_bear")
_filled = ", ".join(f"{r(f'coalesce({c}, 0)')} AS {c}" for c in MOMS)


@query(
    "f12_momentum_binary",
    check_sql(
        "dyn_weight",
        f"""SELECT kdcode, dt, {_filled}, sp::DOUBLE AS slow_signal, fp::DOUBLE AS fast_signal, wp::DOUBLE AS weekly_signal,
    {r('CASE WHEN sp = 0 OR fp = 0 THEN 0 ELSE (1 - weight) * sp + weight * fp END', 5)} AS momentum_blend, {CYCLE} FROM dyn_weight""",
    ),
)
def f12(spark, sf):
    df = mo.add_momentum_binary(bars(spark, sf), DYN).select("kdcode", "dt", *MOMS, *SIGNALS, *CYCLES)
    return rounded(rounded(df, *MOMS), "momentum_blend", digits=5)


def _z(n: str) -> str:
    m = f"coalesce({n}_momentum, 0)"
    return f"coalesce(least(greatest(({m} - avg({m}) OVER (PARTITION BY dt)) / (stddev_samp({m}) OVER (PARTITION BY dt) + 1e-8), -3), 3), 0)"


def _safe_z(n: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY dt) < 2 THEN 0 ELSE {_z(n)} END"


@query(
    "f13_momentum_continuous",
    check_sql(
        "pos_std",
        f"""WITH z AS (SELECT *, CASE WHEN sp = 0 THEN 0 ELSE {_safe_z('slow')} END AS ss, CASE WHEN fp = 0 THEN 0 ELSE {_safe_z('fast')} END AS fs, {_safe_z('weekly')} AS ws FROM pos_std)
    SELECT kdcode, dt, {_filled}, {r('ss', 5)} AS slow_signal, {r('fs', 5)} AS fast_signal, {r('ws', 5)} AS weekly_signal,
    {r('CASE WHEN sp = 0 OR fp = 0 THEN 0 ELSE 0.5 * ss + 0.5 * fs END', 5)} AS momentum_blend, {CYCLE} FROM z""",
    ),
)
def f13(spark, sf):
    df = mo.add_momentum_continuous(bars(spark, sf)).select("kdcode", "dt", *MOMS, *SIGNALS, *CYCLES)
    return rounded(rounded(df, *MOMS), *SIGNALS, digits=5)


def _pct(n: str) -> str:
    m = f"coalesce({n}_momentum, 0)"
    return f"(rank() OVER (PARTITION BY dt ORDER BY {m}) + (count(*) OVER (PARTITION BY dt, {m}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY dt)"


def _buf(n: str) -> str:
    m = f"coalesce({n}_momentum, 0)"
    return f"""CASE WHEN NOT bool_or({m} <> 0) OVER (PARTITION BY dt) OR {n[0]}q < 0.1::DOUBLE OR {n[0]}q > 0.9::DOUBLE THEN 0
    ELSE ({n[0]}q - 0.1::DOUBLE) / (0.9::DOUBLE - 0.1::DOUBLE) * 2 - 1 END"""


@query(
    "f14_momentum_buffered",
    check_sql(
        "pos_std",
        f"""WITH p AS (SELECT *, ({_pct('slow')})::DOUBLE AS sq, ({_pct('fast')})::DOUBLE AS fq, ({_pct('weekly')})::DOUBLE AS wq FROM pos_std),
    z AS (SELECT *, CASE WHEN sp = 0 THEN 0 ELSE {_buf('slow')} END AS ss, CASE WHEN fp = 0 THEN 0 ELSE {_buf('fast')} END AS fs, {_buf('weekly')} AS ws FROM p),
    b AS (SELECT *, CASE WHEN sp = 0 OR fp = 0 THEN 0 ELSE 0.5::DOUBLE * ss + 0.5::DOUBLE * fs END AS blend FROM z)
    SELECT kdcode, dt, {_filled}, {r('ss', 5)} AS slow_signal, {r('fs', 5)} AS fast_signal, {r('ws', 5)} AS weekly_signal, {r('blend', 5)} AS momentum_blend,
    {CYCLE}, CASE WHEN abs(blend) < 0.2::DOUBLE THEN 0 ELSE sign(blend) END::DOUBLE AS trade_signal FROM b""",
    ),
)
def f14(spark, sf):
    df = mo.add_momentum_buffered(bars(spark, sf)).select("kdcode", "dt", *MOMS, *SIGNALS, *CYCLES, "trade_signal")
    return rounded(rounded(df, *MOMS), *SIGNALS, digits=5)


def _vol(n: int) -> str:
    return f"{gate('stddev_samp(ret)', 'ret', n)} * sqrt(252)"


share("vols", f"SELECT kdcode, dt, {_vol(5)} AS v5, {_vol(21)} AS v21 FROM daily_ret", "daily_ret")
_vol_cols = ("volatility_5d", "volatility_21d", "vol_ratio")


@query(
    "f15_volatility",
    check_sql(
        "vols",
        f"""WITH f AS (SELECT kdcode, dt, coalesce(v5, median(v5) OVER (PARTITION BY kdcode), 0.2) AS s, coalesce(v21, median(v21) OVER (PARTITION BY kdcode), 0.2) AS l FROM vols)
    SELECT kdcode, dt, {r('s')} AS volatility_5d, {r('l')} AS volatility_21d, {r('least(greatest(s / (l + 1e-8), 0.1), 10)')} AS vol_ratio FROM f""",
    ),
)
def f15(spark, sf):
    return rounded(fe.add_volatility_features(bars(spark, sf)).select("kdcode", "dt", *_vol_cols), *_vol_cols)


@query(
    "f16_rsi",
    check_sql(
        "bars_d",
        f"""WITH d AS (SELECT kdcode, dt, coalesce(greatest(close - lag(close) OVER {W}, 0), 0) AS g, coalesce(greatest(lag(close) OVER {W} - close, 0), 0) AS l FROM bars_d),
    x AS (SELECT kdcode, dt, {gate('avg(g)', 'g', 14)} AS ag, {gate('avg(l)', 'l', 14)} AS al FROM d),
    y AS (SELECT kdcode, dt, 100 - 100 / (1 + ag / (al + 1e-8)) AS rsi FROM x)
    SELECT kdcode, dt, {r('coalesce(rsi, 50)', 5)} AS rsi_14, {r('coalesce((rsi - 50) / 50, 0)')} AS rsi_normalized FROM y""",
    ),
)
def f16(spark, sf):
    df = fe.add_rsi(bars(spark, sf)).select("kdcode", "dt", "rsi_14", "rsi_normalized")
    return rounded(rounded(df, "rsi_14", digits=5), "rsi_normalized")


@query(
    "f17_moving_averages",
    check_sql(
        "bars_d",
        f"""WITH a AS (SELECT kdcode, dt, close, avg(close) OVER {rows(50)} AS s, avg(close) OVER {rows(200)} AS l FROM bars_d)
    SELECT kdcode, dt, {r('(close - s) / s')} AS dist_ma50, {r('(close - l) / l')} AS dist_ma200, (round(s, 7) > round(l, 7))::INTEGER::DOUBLE AS ma_cross FROM a""",
    ),
)
def f17(spark, sf):
    # Up to row 50 both averages are over the same rows, and equal; in SQL they differ by float noise, so it compares at 7 digits.
    df = fe.add_moving_average_features(bars(spark, sf))
    return rounded(df.select("kdcode", "dt", "dist_ma50", "dist_ma200", "ma_cross"), "dist_ma50", "dist_ma200")


def sparse_macro(spark, sf):
    """The series without some days, so that carrying forward matters."""
    return td.macro_d(spark, sf).where(~F.dayofmonth("dt").isin(3, 4, 20))


share("sparse_macro", "SELECT * FROM macro_d WHERE day(dt) NOT IN (3, 4, 20)", "macro_d")


@query(
    "f18_vix",
    check_sql(
        "bars_d sparse_macro",
        f"""WITH v AS (SELECT dt, vix, coalesce(vix / lag(vix) OVER (ORDER BY dt) - 1, 0) AS vix_change,
      (round(vix, 9) > round(avg(vix) OVER (ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9))::INTEGER::DOUBLE AS vix_regime FROM sparse_macro)
    SELECT b.kdcode, b.dt, {r('coalesce(a.vix, 20)')} AS vix, {r('coalesce(e.vix_change, 0)')} AS vix_change, coalesce(e.vix_regime, 0) AS vix_regime
    FROM bars_d b ASOF LEFT JOIN v a ON b.dt >= a.dt LEFT JOIN v e ON e.dt = b.dt""",
    ),
)
def f18(spark, sf):
    df = fe.add_vix_features(bars(spark, sf).select("kdcode", "dt"), sparse_macro(spark, sf))
    return rounded(df, "vix", "vix_change")


def _cz(c: str) -> str:
    w = "(ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    return f"coalesce(least(greatest(coalesce(({c} - avg({c}) OVER {w}) / (CASE WHEN count({c}) OVER {w} > 1 THEN stddev_samp({c}) OVER {w} END + 1e-8), 0), -3), 3), 0)"


@query(
    "f19_credit",
    check_sql(
        "bars_d sparse_macro",
        f"""WITH c AS (SELECT dt, ig_spread, hy_spread, coalesce(ig_spread / nullif(lag(ig_spread) OVER (ORDER BY dt), 0) - 1, 0) AS ig_spread_change,
      coalesce(hy_spread / nullif(lag(hy_spread) OVER (ORDER BY dt), 0) - 1, 0) AS hy_spread_change, {_cz('ig_spread')} AS ig_spread_zscore, {_cz('hy_spread')} AS hy_spread_zscore,
      hy_spread - ig_spread AS credit_spread_diff FROM sparse_macro)
    SELECT b.kdcode, b.dt, """
        + ", ".join(f"{r(f'coalesce(c.{x}, 0)', 5 if x.endswith(('change', 'score')) else 8)} AS {x}" for x in fe.CREDIT_FEATURES)
        + " FROM bars_d b ASOF LEFT JOIN c ON b.dt >= c.dt",
    ),
)
def f19(spark, sf):
    df = fe.add_credit_features(bars(spark, sf).select("kdcode", "dt"), sparse_macro(spark, sf))
    ratios = [c for c in fe.CREDIT_FEATURES if c.endswith(("change", "score"))]
    return rounded(rounded(df, *ratios, digits=5), *[c for c in fe.CREDIT_FEATURES if c not in ratios], digits=8)


def _dense(name: str) -> str:
    """The check SQL of a market-wide family on the full series."""
    return ORACLES[name].replace(SHARED["sparse_macro"][1], "SELECT * FROM macro_d")


_families = ("f2_price_features", "f3_volume_features", "f12_momentum_binary", "f15_volatility", "f16_rsi", "f17_moving_averages", "g6_panel_regime")


@query(
    "f20_feature_set",
    check_sql(
        "bars_d",
        "SELECT b.kdcode, b.dt, "
        + ", ".join(f"{r(f'b.{c}', 7)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
        + f", {r('b.close * b.volume', 7)} AS turnover, "
        + ", ".join(f"x{i}.* EXCLUDE (kdcode, dt)" for i in range(len(_families) + 2))
        + " FROM bars_d b "
        + " ".join(
            f"JOIN ({q}) x{i} ON x{i}.kdcode = b.kdcode AND x{i}.dt = b.dt"
            for i, q in enumerate([*[ORACLES[n] for n in _families], _dense("f18_vix"), _dense("f19_credit")])
        ),
    ),
)
def f20(spark, sf):
    c = FeatureConfig(
        price=True, volume=True, volatility=True, vix=True, credit=True, regime=True, rsi=True, moving_averages=True, momentum_settings=DYN
    )
    m = td.macro_d(spark, sf)
    df = add_features(bars(spark, sf), c, m.select("dt", "vix"), m.select("dt", "ig_spread", "hy_spread"), td.regime_d(spark, sf))
    seven = ("open", "high", "low", "close", "volume", "turnover", "dollar_volume")
    eight = ("ig_spread", "hy_spread", "credit_spread_diff")
    five = ("momentum_blend", "rsi_14", "ig_spread_change", "hy_spread_change", "ig_spread_zscore", "hy_spread_zscore")
    six = [x for x in df.columns if x not in ("kdcode", "dt", *seven, *eight, *five)]
    return rounded(rounded(rounded(rounded(df, *seven, digits=7), *eight, digits=8), *five, digits=5), *six)
