import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import ranking as rk
from rankloom.operators import features as fe
from rankloom.operators import momentum as mo
from rankloom.operators import regime as re
from rankloom.operators.feature_sets import FeatureConfig, add_features, feature_columns

BARS = "kdcode bigint, dt date, open double, high double, low double, close double, volume double"


def walk(spark, names=6, days=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(names):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        for i in range(days):
            rows.append((k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(p[i] * 0.99), float(p[i] * 1.02), float(p[i] * 0.97), float(p[i]), float(rng.integers(1, 99))))
    return spark.createDataFrame(rows, BARS)


def test_market_states_follow_the_signs_of_both_horizons(spark):
    """Every (slow, fast) pair of signs, zeros among them, on seeded paths with flat stretches."""
    rng = np.random.default_rng(77)
    steps = rng.choice([-0.03, 0.0, 0.02, 0.05], size=(12, 30))
    rows = []
    for k, path in enumerate(np.cumprod(1 + steps, axis=1) * 40):
        rows += [(k, dt.date(2022, 5, 1) + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(path)]
    m = mo.Momentum(fast=2, slow=5, weekly=1)
    seen = set()
    for r in mo.add_momentum_binary(spark.createDataFrame(rows, BARS), m).collect():
        i = (r.dt - dt.date(2022, 5, 1)).days
        if i >= 6:
            slow, fast = (round(float(np.sum(steps[r.kdcode, i - n + 1 : i + 1])), 9) for n in (5, 2))
            if slow and fast:  # a sum of returns at zero is decided by rounding
                signs = (1 if slow > 0 else -1, 1 if fast > 0 else -1)
                assert (r.slow_signal, r.fast_signal) == signs
                assert r.momentum_blend == sum(signs) / 2
                seen.add(signs)
    assert len(seen) == 4


def dynamic_by_loop(close, m):
    """Fast weight of each row of one entity from plain lists."""
    r = [np.nan] + [close[i] / close[i - 1] - 1 for i in range(1, len(close))]

    def roll(n, i):
        w = r[max(0, i - n + 1): i + 1]
        return sum(w) if len(w) == n and not np.isnan(w).any() else None

    pos = lambda x: 0 if x is None else (1 if x >= 0 else -1)
    state = []
    for i in range(len(close)):
        state.append({(1, 1): "Bu", (1, -1): "Co", (-1, -1): "Be", (-1, 1): "Re"}.get((pos(roll(m.slow, i)), pos(roll(m.fast, i)))))
    out = []
    for i in range(len(close)):
        past = [(state[j], r[j + 1]) for j in range(i) if state[j]]
        g = {s: [x for t, x in past if t == s] for s in ("Bu", "Co", "Be", "Re")}
        w = 0.5
        if state[i] in ("Co", "Re"):
            s = state[i]
            w = m.correction_weight if s == "Co" else m.rebound_weight
            if len(past) >= m.min_history and all(len(g[x]) >= m.min_state_rows for x in ("Bu", "Be", s)):
                n = len(past)
                slope = sum(g["Bu"]) / n - sum(g["Be"]) / n
                sq = np.mean(np.square(g[s]))
                if slope > 1e-12 and sq > 1e-12:
                    if s == "Co":
                        w = 0.5 * (1 - np.sum(np.square(g["Bu"])) / n / slope * np.mean(g[s]) / sq)
                    else:
                        w = 0.5 * (1 + np.sum(np.square(g["Be"])) / n / slope * np.mean(g[s]) / sq)
            w = min(max(w, 0), 1)
        out.append(w)
    return out


def test_dynamic_weight_equals_independent_formula(spark):
    m = mo.Momentum(fast=3, slow=8, blend="dynamic", min_history=15, min_state_rows=2)
    df = walk(spark, 3, 80)
    raw = mo.add_raw_momentum(df, m)
    pos = raw.select("kdcode", "dt", "_ret", mo.position(F.col("slow_momentum")).alias("_slow_pos"), mo.position(F.col("fast_momentum")).alias("_fast_pos"))
    got = mo.add_blend_weight(pos, m).toPandas().sort_values(["kdcode", "dt"])
    close = df.toPandas().sort_values(["kdcode", "dt"])
    weights = []
    for k in range(3):
        want = dynamic_by_loop(close.loc[close["kdcode"] == k, "close"].tolist(), m)
        np.testing.assert_allclose(got.loc[got["kdcode"] == k, "_weight"], want, atol=1e-9)
        weights += want
    assert len(set(np.round(weights, 6))) > 5


CUT = dt.date(2024, 3, 1)


@pytest.mark.parametrize(
    "chain",
    [
        lambda d: mo.add_momentum_binary(d, mo.Momentum(3, 10, 2, blend="dynamic", min_history=10)),
        lambda d: mo.add_momentum_continuous(d, mo.Momentum(3, 10, 2)),
        lambda d: mo.add_momentum_buffered(d, mo.Momentum(3, 10, 2)),
        fe.add_rsi,
        fe.add_moving_average_features,
        fe.add_price_features,
    ],
)
def test_later_rows_change_nothing_before(spark, chain):
    df = walk(spark)
    changed = df.withColumn("close", F.when(F.col("dt") > F.lit(CUT), F.col("close") * 3 + 1).otherwise(F.col("close")))
    a, b = (chain(x).where(F.col("dt") <= F.lit(CUT)).drop("open", "high", "low", "close", "volume") for x in (df, changed))
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_buffered_momentum_reads_its_rows_once(spark, monkeypatch):
    """Whole dates are sorted for all three ranks after one shuffle of the rows; dates beyond a slice give the same."""
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    flat = F.when(F.col("kdcode") < 2, 7.0).otherwise(F.col("close"))  # equal values, and a first date with zeros only
    df = walk(spark, 12, 40).withColumn("close", flat)
    m = mo.Momentum(3, 10, 2)
    got = mo.add_momentum_buffered(df.mapInArrow(noted, BARS), m)
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(dt#") == 1
    a = got.toPandas().sort_values(["kdcode", "dt"]).reset_index(drop=True)
    assert len(a) == 480 and made.value == 2 * 480  # once to count the dates' rows
    assert a["slow_signal"].nunique() > 5
    monkeypatch.setattr(rk, "SLICE", 5)
    b = mo.add_momentum_buffered(df, m).toPandas().sort_values(["kdcode", "dt"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_row_order_does_not_matter(spark):
    df = walk(spark)
    a = fe.add_volatility_features(df)
    b = fe.add_volatility_features(df.orderBy(F.rand(1)).repartition(11))
    pa, pb = (x.toPandas().sort_values(["kdcode", "dt"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(pa, pb)


def test_rsi_first_values(spark):
    df = walk(spark, 1, 20)
    c = df.orderBy("dt").toPandas()["close"]
    d = c.diff()
    gain, loss = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    want = (100 - 100 / (1 + gain / (loss + 1e-8))).fillna(50)
    got = fe.add_rsi(df).orderBy("dt").toPandas()["rsi_14"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_series_start_later_than_panel(spark):
    df = walk(spark, 2, 10).select("kdcode", "dt")
    s = spark.createDataFrame([(dt.date(2024, 1, 4), 15.0), (dt.date(2024, 1, 6), 30.0)], "dt date, vix double")
    got = {r.dt.day: (r.vix, r.vix_change) for r in fe.add_vix_features(df, s).where("kdcode = 1").collect()}
    assert got[1] == (20.0, 0.0) and got[5] == (15.0, 0.0) and got[6] == (30.0, 1.0) and got[9] == (30.0, 0.0)


def test_feature_set_columns_and_missing_series(spark):
    c = FeatureConfig(vix=True, extra=("close", "note"))
    names = feature_columns(c)
    assert names[:6] == ["close", "open", "high", "low", "volume", "turnover"] and names.count("close") == 1 and names[-1] == "note"
    c = FeatureConfig(vix=True, momentum=False)
    row = add_features(walk(spark, 1, 3), c).first()
    assert (row.vix, row.vix_change) == (0.0, 0.0)
    with pytest.raises(ValueError):
        add_features(walk(spark, 1, 3), FeatureConfig(vix=True, momentum=False, strict=True))


# --- regime ----------------------------------------------------------------------------------


def monthly_regime(spark, months=60, seed=0, bump_after=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(months):
        d = (pd.Timestamp("2000-01-31") + pd.offsets.MonthEnd(i)).date()
        v = [float(x) for x in 100 + np.cumsum(rng.normal(size=5))]
        if bump_after is not None and i > bump_after:
            v = [x * 2 for x in v]
        rows.append((d, *v))
    return spark.createDataFrame(rows, "dt date, regime_market double, regime_yield_curve double, regime_oil double, regime_copper double, regime_stock_bond_corr double")


def regime_by_loop(pdf, p):
    cols = [c for c in pdf.columns if c != "dt"]
    ch = pdf[cols] - pdf[cols].shift(p.change)
    roll = ch.rolling(p.window, min_periods=max(p.min_history, p.change + 1))
    z = ((ch - roll.mean()) / (roll.std() + 1e-8)).clip(-3, 3).to_numpy()
    m = pdf["regime_market"].to_numpy()
    rows = []
    for t in range(len(z)):
        found = []
        for i in range(max(0, t - p.exclusion)):
            ok = ~np.isnan(z[t]) & ~np.isnan(z[i])
            if ok.any():
                found.append((float(np.sqrt(((z[t] - z[i])[ok] ** 2).sum())), i))
        if len(found) < p.min_history:
            rows.append((np.nan, np.nan, np.nan))
            continue
        found.sort()
        q = max(1, int(len(found) * p.quantile))
        near = [i for _, i in found[:q]]
        rows.append((np.mean([d for d, _ in found]), np.mean([d for d, _ in found[:q]]), np.mean([m[i + 1] / m[i] - 1 for i in near])))
    return np.array(rows)


def test_regime_equals_loop(spark):
    p = re.Regime(change=3, window=24, min_history=6)
    df = monthly_regime(spark)
    got = re.regime_features(df, p).orderBy("dt").toPandas()
    want = regime_by_loop(df.orderBy("dt").toPandas(), p)
    cols = ["regime_global_score", "regime_similarity_q20_mean", "regime_similar_subsequent_return_1m"]
    np.testing.assert_allclose(got[cols].to_numpy(dtype=float), want, atol=1e-9)
    assert got["regime_global_score"].notna().sum() > 20


def test_regime_does_not_look_ahead(spark):
    p = re.Regime(change=3, window=24, min_history=6)
    a, b = (re.regime_features(monthly_regime(spark, bump_after=x), p).orderBy("dt").toPandas().iloc[:41] for x in (None, 40))
    pd.testing.assert_frame_equal(a, b)


def test_regime_settings_are_checked():
    assert re.normal_horizons([3, 1, 3]) == (3, 1)
    for bad in ([0], [1.5]):
        with pytest.raises(ValueError):
            re.normal_horizons(bad)
    with pytest.raises(ValueError):
        re.Regime(exclusion=0)
