import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import portfolio as po
from rankloom.plans import catalog

def stepped_bars(spark, n_names=7, n_days=12):
    """Prices of a seeded walk with its opens and closes by (name, day), some days without a bar."""
    rng = np.random.default_rng(41)
    days = [dt.date(2023, 3, 6) + dt.timedelta(days=2 * i) for i in range(n_days)]
    opens, closes, rows = {}, {}, []
    for k in range(n_names):
        price = float(rng.uniform(8, 60))
        for d in days:
            o = price * float(rng.uniform(0.94, 1.07))
            price = o * float(rng.uniform(0.95, 1.06))
            if (k + d.day) % 5:
                opens[k, d], closes[k, d] = o, price
                rows.append((k, d, o, max(o, price) + 0.1, min(o, price) - 0.1, price, 10.0 + k))
    df = spark.createDataFrame(rows, "kdcode bigint, dt date, open double, high double, low double, close double, volume double")
    return df, days, opens, closes


def test_top_names_earn_their_open_to_open_returns(spark):
    """Three best of seven names by a score that changes every day, against returns read off the price table."""
    bars, days, opens, _ = stepped_bars(spark)
    rng = np.random.default_rng(5)
    score = {(k, d): float(rng.normal()) for d in days for k in range(7)}
    scores = spark.createDataFrame([(4, d, k, v) for (k, d), v in score.items()], "model_id int, dt date, kdcode bigint, score double")
    s = po.strategies_frame(spark, [po.Strategy(9, 4, 3, 1, "daily", 0.004, 0.001, 0)])
    got = {r.pred_date: r for r in po.backtest(scores, bars, s).daily.collect()}
    held: set = set()
    for i, d in enumerate(days[:-1]):
        entry = days[i + 1]
        best = set(sorted(range(7), key=lambda k: (-score[k, d], k))[:3])
        gains = []
        for k in best:
            later = [x for x in days if x > entry and (k, x) in opens]
            if (k, entry) in opens and later:
                gains.append(opens[k, later[0]] / opens[k, entry] - 1)
        if not gains:
            assert d not in got
            continue
        moved = len(best ^ held) / 6
        assert got[d].entry_date == entry
        assert got[d].gross_return == pytest.approx(np.mean(gains), abs=1e-12)
        assert got[d].turnover == pytest.approx(moved) and got[d].cost == pytest.approx(moved * 0.006)
        held = best


def test_return_columns_follow_the_prices(spark):
    bars, _, opens, closes = stepped_bars(spark)
    for k in (0, 3):
        mine = [d for n, d in opens if n == k]
        rows = {r.dt: r for r in po.return_columns(bars, 3).where(f"kdcode = {k}").collect()}
        for before, d in zip(mine, mine[1:]):
            assert rows[d].overnight_gap == pytest.approx(opens[k, d] / closes[k, before] - 1)
            assert rows[before].open_to_open_return == pytest.approx(opens[k, d] / opens[k, before] - 1)
        assert rows[mine[0]].overnight_gap == 0.0 and rows[mine[-1]].open_to_open_return is None


def test_turnover_equals_set_differences(spark):
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(11, 4, replace=False).tolist()) for _ in range(9)]
    df = spark.createDataFrame([(2, n, k, 4) for n, held in enumerate(sets) for k in held], "s int, n int, kdcode int, k int")
    got = [r.one_way_turnover for r in po.turnover(df, ("s",), "n", "k").orderBy("n").collect()]
    assert got == [len(now ^ before) / 8 for before, now in zip([set(), *sets], sets)]


def test_gate_step_equals_the_rule(spark):
    """One gate decision for three strategies on a seeded ranking, name by name."""
    rng = np.random.default_rng(12)
    rank = {int(k): i + 1 for i, k in enumerate(rng.permutation(40)[:30])}
    before = {int(k): i + 1 for i, k in enumerate(rng.permutation(40)[:25])}
    ranked = spark.createDataFrame([(3, k, 1.0 / r, r) for k, r in rank.items()], "model_id int, kdcode bigint, score double, rank bigint")
    prev = spark.createDataFrame([(3, k, r) for k, r in before.items()], "model_id int, kdcode bigint, prev_rank bigint")
    held = {21: set(rng.choice(40, 6, replace=False).tolist()), 22: set(rng.choice(40, 9, replace=False).tolist()), 23: set()}
    holdings = spark.createDataFrame([(s, k) for s, names in held.items() for k in names], "strategy_id int, kdcode bigint")
    table = [po.Strategy(21, 3, 6, 1, "daily", 0, 0, 5), po.Strategy(22, 3, 9, 1, "daily", 0, 0, 12), po.Strategy(23, 3, 4, 1, "daily", 0, 0, 3)]
    got = {(r.strategy_id, r.kdcode): (r.status, r.rank_drop) for r in po.rank_drop_step(ranked, holdings, prev, po.strategies_frame(spark, table)).collect()}
    want = {}
    for s in table:
        stay = set()
        for k in held[s.strategy_id]:
            if k not in rank:
                want[s.strategy_id, k] = ("dropped", None)
                continue
            fall = rank[k] - before[k] if k in before else None
            leaves = fall is not None and fall >= s.min_rank_drop
            want[s.strategy_id, k] = ("exit" if leaves else "survivor", fall)
            stay |= set() if leaves else {k}
        free = [k for k in sorted(rank, key=rank.get)[: s.top_k] if k not in stay][: s.top_k - len(stay)]
        for k in free:
            if want.get((s.strategy_id, k), ("",))[0] != "exit":
                want[s.strategy_id, k] = ("entry", None)
    assert {k: v for k, v in got.items() if v[0] != "entry"} == {k: v for k, v in want.items() if v[0] != "entry"}
    assert {k for k, v in want.items() if v[0] == "entry"} <= set(got)


def test_k_follows_the_strategies(spark):
    """A strategy may hold more names than any other; K is not a setting."""
    bars, days, _, _ = stepped_bars(spark)
    scores = spark.createDataFrame([(1, d, k, float(k)) for d in days for k in range(7)], "model_id int, dt date, kdcode bigint, score double")
    table = po.strategies_frame(spark, [po.Strategy(1, 1, 2, 1, "daily", 0, 0, 0), po.Strategy(2, 1, 7, 1, "daily", 0, 0, 0)])
    sizes = {(r.strategy_id, r.n) for r in po.backtest(scores, bars, table).targets.groupBy("strategy_id", "seq").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(1, 2), (2, 7)}


# --- the gate over many days against a plain day loop -----------------------------------------


def random_market(seed, n_names=30, n_days=40):
    rng = np.random.default_rng(seed)
    days = [d.date() for d in pd.bdate_range("2024-01-01", periods=n_days)]
    bars, scores = [], []
    level = rng.normal(size=n_names)
    for i, d in enumerate(days):
        level = level * 0.8 + rng.normal(size=n_names)
        short = i in (7, 8, 20)
        for k in range(n_names):
            if rng.random() < 0.75:
                p = 50 + 10 * rng.random()
                bars.append((k, d, p, p, p, p, 1.0))
            if rng.random() < (0.08 if short else 0.9) or (k == 0 and short):
                scores.append((1, d, k, float(level[k])))
    return days, bars, scores


def loop_backtest(bars, scores, s: po.Strategy):
    """Day by day with dicts and sets, for one strategy."""
    b = pd.DataFrame(bars, columns=["k", "d", "o", "h", "l", "c", "v"]).sort_values(["k", "d"])
    b["r"] = b.groupby("k")["o"].shift(-1) / b["o"] - 1
    ret = {(k, d): r for k, d, r in zip(b["k"], b["d"], b["r"]) if not np.isnan(r)}
    cal = sorted(b["d"].unique())
    by_day = {}
    for _, d, k, v in scores:
        by_day.setdefault(d, []).append((-v, k))
    held = {t: set() for t in range(s.holding if s.style == "staggered" else 1)}
    ranks = {t: None for t in held}
    out = {}
    for i, d in enumerate(sorted(by_day)):
        order = [k for _, k in sorted(by_day[d])]
        rank = {k: j + 1 for j, k in enumerate(order)}
        nxt = [c for c in cal if c > d]
        entry = nxt[0] if d in cal and nxt else None
        t = i % s.holding if s.style == "staggered" else 0
        enough = len(order) >= s.top_k
        turned = s.style != "block" or i % s.holding == 0
        traded = 0.0
        if not enough:
            if s.style == "daily":
                ranks[0] = None
            if s.style != "block" or entry is None or not held[0]:
                continue
            turned = False
        new = held[t]
        if turned and enough:
            fresh = not held[t] or ranks[t] is None or not s.min_rank_drop
            if fresh:
                new = set(order[: s.top_k])
            else:
                stay = [k for k in held[t] if k in rank and not (k in ranks[t] and rank[k] - ranks[t][k] >= s.min_rank_drop)]
                new = set(stay + [k for k in order if k not in stay][: max(0, s.top_k - len(stay))])
            traded = len(new ^ held[t]) / (2 * s.top_k)
            ranks[t] = rank
            if s.style != "daily":
                held[t] = new
        if entry is None:
            continue
        groups = [new] if s.style == "daily" else [g for g in held.values() if g]
        means = [np.mean(x) for x in ([ret[(k, entry)] for k in g if (k, entry) in ret] for g in groups) if x]
        if not means:
            continue
        if s.style == "daily":
            held[0] = new
        share = s.holding if s.style == "staggered" else 1
        out[d] = (float(np.mean(means)), traded / share)
    return out


CASES = [("daily", 1, 0), ("daily", 1, 6), ("daily", 1, 2), ("staggered", 3, 0), ("staggered", 3, 5), ("block", 4, 0), ("block", 4, 6)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_styles_equal_the_day_loop(spark, seed):
    _, bars, scores = random_market(seed)
    strategies = [po.Strategy(i, 1, 4, h, style, 0.001, 0.0005, drop) for i, (style, h, drop) in enumerate(CASES)]
    b = spark.createDataFrame(bars, "kdcode bigint, dt date, open double, high double, low double, close double, volume double")
    sc = spark.createDataFrame(scores, "model_id int, dt date, kdcode bigint, score double")
    table = po.strategies_frame(spark, strategies)
    plain = po.backtest(sc, b, table.where("min_rank_drop = 0")).daily
    gated = po.gated_backtest(po.rank_scores(sc), b, table.where("min_rank_drop > 0")).daily
    rows = plain.unionByName(gated).collect()
    for s in strategies:
        got = {r.pred_date: (r.gross_return, r.turnover) for r in rows if r.strategy_id == s.strategy_id}
        want = loop_backtest(bars, scores, s)
        assert got.keys() == want.keys(), s
        for d in want:
            assert got[d] == pytest.approx(want[d], abs=1e-12), (s, d)


def test_gate_rows_drop_names_that_cannot_matter(spark):
    _, bars, scores = random_market(5)
    b = spark.createDataFrame(bars, "kdcode bigint, dt date, open double, high double, low double, close double, volume double")
    ranked = po.rank_scores(spark.createDataFrame(scores, "model_id int, dt date, kdcode bigint, score double"))
    s = po.strategies_frame(spark, [po.Strategy(1, 1, 2, 1, "staggered", 0, 0, 3)])
    returns = po.open_to_open(b)
    rebal = po.rebalances(po.prediction_days(ranked, s, po.entry_dates(b)))
    kept = po.gate_rows(ranked, rebal, returns).count()
    assert kept < 0.6 * ranked.count()


def test_bad_strategies_are_refused():
    for bad in (dict(top_k=0), dict(style="weekly"), dict(holding=2)):
        with pytest.raises(ValueError):
            po.Strategy(**{**dict(strategy_id=1, model_id=1, top_k=1, holding=1, style="daily", spread=0, slippage=0, min_rank_drop=0), **bad})


def test_calendar_fills_days_without_trades(spark):
    d = [dt.date(2024, 1, x) for x in (1, 2, 3, 4)]
    daily = spark.createDataFrame([(1, d[0], 0.1), (1, d[2], 0.2)], "strategy_id int, entry_date date, net_return double")
    bm = spark.createDataFrame([(x, 0.01 if i else None) for i, x in enumerate(d)], "dt date, benchmark_return double")
    got = [(r.portfolio_return, r.benchmark_return) for r in po.calendar_returns(daily, bm).orderBy("dt").collect()]
    assert got == [(0.1, 0.0), (0.0, 0.01), (0.2, 0.01)]


def test_backtest_outputs_compute_targets_and_holdings_once(spark, monkeypatch):
    """Eight written tables share them; every row of either is made once."""
    seen = {}

    def once(name):
        made, rows = getattr(po, name), spark.sparkContext.accumulator(0)
        seen[name] = rows, []

        def counted(frames):
            for f in frames:
                rows.add(len(f))
                yield f

        def wrapped(*a):
            df = made(*a)
            seen[name][1].append(df)
            return df.mapInPandas(counted, df.schema)

        monkeypatch.setattr(po, name, wrapped)

    once("top_targets")
    once("holdings_records")
    assert catalog.QUERIES["s15_backtest_outputs"](spark, "/root/testdata/sf0.001").count() > 0
    for rows, made in seen.values():
        assert len(made) == 1 and rows.value == made[0].count() > 0
