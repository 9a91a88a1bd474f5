import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import clean, drift as dr, evaluate as ev, experiments as ex, graph as gr
from rankloom.operators import ledger as le, normalize as no, performance as pf, sequences as sq

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(500)]


def matrix(spark, scores, rets):
    rows = [(1, D[i], j, float(s), float(r)) for i, (a, b) in enumerate(zip(scores, rets)) for j, (s, r) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "model_id int, dt date, kdcode bigint, score double, ret double")


def test_top_k_means_with_ties(spark):
    rng = np.random.default_rng(23)
    score, gain = rng.integers(0, 4, (6, 9)) / 4, rng.normal(0, 0.05, (6, 9))
    got = [r.r for r in ev.top_k_daily(matrix(spark, score.tolist(), gain.tolist()), [4]).orderBy("dt").collect()]
    want = [np.mean([g[k] for k in sorted(range(9), key=lambda k: (-x[k], k))[:4]]) for x, g in zip(score, gain)]
    assert got == pytest.approx(want)


def test_rank_correlation_equals_numpy(spark):
    rng = np.random.default_rng(31)
    x, y = rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    rank = lambda v: np.argsort(np.argsort(v, axis=1), axis=1)
    want = [np.corrcoef(a, b)[0, 1] for a, b in zip(rank(x), rank(y))]
    assert [r.ic for r in ev.daily_rank_ic(matrix(spark, x.tolist(), y.tolist())).orderBy("dt").collect()] == pytest.approx(want)
    assert ev.daily_ic(matrix(spark, [[0.5] * 6], [[0.1, 0.4, 0.2, 0.3, 0.0, 0.6]])).count() == 0


def test_newey_west_equals_formula(spark):
    x = np.sin(np.arange(11) * 1.7) * 0.02 + np.cos(np.arange(11) * 0.4) * 0.013
    df = spark.createDataFrame([(1, 5, D[i], float(v)) for i, v in enumerate(x)], "model_id int, k int, dt date, r double")
    for lags in (0, 3, 20):
        c = x - x.mean()
        n, top = len(x), min(lags, len(x) - 1)
        var = c @ c / n + sum(2 * (1 - l / (top + 1)) * (c[l:] @ c[:-l]) / n for l in range(1, top + 1))
        r = ev.newey_west(df, lags).first()
        assert r.nw_std == pytest.approx(np.sqrt(max(var, 0)), abs=1e-12)
    assert ev.newey_west(df, 3).first().nw_std != pytest.approx(x.std())


def test_bootstrap_is_repeatable_and_stays_inside(spark):
    x = [0.31, -0.12, 0.07, 0.44, -0.25, 0.18, 0.02, 0.29]
    df = spark.createDataFrame([(6, 3, D[i], v) for i, v in enumerate(x)], "model_id int, k int, dt date, r double")
    a, b = (ev.bootstrap(df, 3, 160, 19).first() for _ in range(2))
    assert a == b and min(x) <= a.ci_lower < np.mean(x) < a.ci_upper <= max(x)
    top = ev.bootstrap(df, 3, 90, 19, statistic=F.max("x")).first()
    assert top.ci_lower <= top.ci_upper <= max(x) + 1e-12
    with pytest.raises(ValueError):
        ev.bootstrap(df, 0, 10, 1)


def test_quantile_buckets_take_the_rest(spark):
    p = matrix(spark, [list(range(12))], [list(range(12))])
    got = {r.quantile: r.mean_return for r in ev.quantile_returns(p).collect()}
    assert got == {1: 0.5, 2: 2.5, 3: 4.5, 4: 6.5, 5: 9.5}


# --- graph -----------------------------------------------------------------------------------


def prices(spark, n=23, days=80, seed=0):
    rng = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (days, n)) + rng.normal(0, 0.01, (days, 1)), axis=0))
    rows = [(k, D[i], float(x[i, k])) for i in range(days) for k in range(n) if (i + k) % 9]
    return spark.createDataFrame(rows, "kdcode bigint, dt date, close double")


def corr_by_pandas(df, end, look):
    p = df.toPandas().sort_values(["kdcode", "dt"])
    p["r"] = p.groupby("kdcode")["close"].pct_change()
    p = p[p["dt"] < end]
    p = p[p["dt"].isin(sorted(p["dt"].unique())[-look:])]
    return p.pivot(index="dt", columns="kdcode", values="r").dropna(how="all").fillna(0).corr()


@pytest.mark.parametrize("block", [4, 512])
def test_blocks_give_the_whole_matrix(spark, block):
    df = prices(spark)
    rows = gr.return_rows(df, gr.snapshot_list(spark, [str(D[70])]), 40)
    got = gr.correlate(rows, None, block=block).toPandas()
    want = corr_by_pandas(df, D[70], 40)
    assert len(got) == 23 * 22
    for r in got.itertuples():
        assert r.corr == pytest.approx(want.loc[r.src, r.dst], abs=1e-12)


@pytest.mark.parametrize("metric", ["corr", "abs_corr"])
def test_top_k_edges_over_blocks(spark, metric):
    df = prices(spark, seed=4)
    sel = gr.Selection(top_k=3, metric=metric)
    rows = gr.return_rows(df, gr.snapshot_list(spark, [str(D[60])]), 40)
    got = gr.rank_edges(gr.correlate(rows, sel, block=5), sel).toPandas()
    want = corr_by_pandas(df, D[60], 40)
    for k in want.columns:
        s = want.loc[k].drop(k)
        best = (s.abs() if metric == "abs_corr" else s).sort_values(ascending=False).index[:3]
        g = got[got["src"] == k].sort_values("rank_pct", ascending=False)
        assert list(g["dst"]) == list(best)
        np.testing.assert_allclose(g["rank_pct"], [1, 2 / 3, 1 / 3])
        np.testing.assert_allclose(g["corr"], s[best].to_numpy())


def groups_of_prices(spark, groups=6, size=12, days=60):
    """Names that follow one of a few drivers closely; two of them are equal, one does not move."""
    rng = np.random.default_rng(8)
    drivers = rng.normal(0, 0.02, (days, groups))
    r = np.repeat(drivers, size, axis=1) + rng.normal(0, 0.001, (days, groups * size))
    r[:, 3], r[:, 7] = r[:, 2], 0
    x = 100 * np.exp(np.cumsum(r, axis=0))
    rows = [(f"n{k:03d}", D[i], float(x[i, k])) for i in range(days) for k in range(groups * size)]
    return spark.createDataFrame(rows, "kdcode string, dt date, close double")


@pytest.mark.parametrize("metric", ["corr", "abs_corr"])
def test_pruned_block_pairs_hold_no_edge(spark, metric):
    rows = gr.return_rows(groups_of_prices(spark), gr.snapshot_list(spark, [str(D[40]), str(D[55])]), 30)
    whole = gr.cells(gr.correlation_matrix(rows, block=512)).toPandas()
    for sel in (gr.Selection(top_k=4, metric=metric), gr.Selection(threshold=0.9)):
        blocks = gr.place(gr.unit_vectors(rows), gr._n_blocks(rows, 8), 8)
        pairs = gr.block_pairs(gr.block_summaries(blocks, sel), sel).toPandas()
        assert 0 < pairs["needed"].mean() < 0.7
        got = gr.rank_edges(gr.correlate(rows, sel, block=8), sel).toPandas()
        want = whole.copy()
        want["score"] = want["corr"].abs() if sel.top_k and metric == "abs_corr" else want["corr"]
        if sel.top_k:
            want["score"] = want["score"].round(12)
            want = want.sort_values(["score", "dst"], ascending=[False, True]).groupby(["valid_from", "src"]).head(4)
            assert len(want) == 2 * 71 * 4
        else:
            want = want[want["corr"] > 0.9]
        keys = ["valid_from", "src", "dst"]
        assert sorted(map(tuple, got[keys].values)) == sorted(map(tuple, want[keys].values))


def test_top_k_task_gives_k_edges_a_source(spark):
    rows = gr.return_rows(prices(spark), gr.snapshot_list(spark, [str(D[60])]), 40)
    assert gr.correlate(rows, gr.Selection(top_k=3), block=5).count() == 23 * 3


@pytest.mark.parametrize("fill", ["zero", "mean"])
def test_packed_matrix_and_its_readers(spark, fill):
    rows = gr.return_rows(prices(spark), gr.snapshot_list(spark, [str(D[60]), str(D[70])]), 40)
    matrix = gr.correlation_matrix(rows, fill, block=6)
    packed = matrix.toPandas()
    n_blocks = packed.groupby("valid_from")["a"].nunique()
    assert list(packed.groupby("valid_from").size()) == [n * (n + 1) / 2 for n in n_blocks]
    cells = {(r.valid_from, r.src, r.dst): r.corr for r in gr.cells(matrix).collect()}
    assert len(cells) == 2 * 23 * 22
    for entity in (0, 9, 22):
        row = {(r.valid_from, r.src, r.dst): r.corr for r in gr.matrix_row(matrix, entity).collect()}
        assert row == {k: v for k, v in cells.items() if k[1] == entity}
    one = {r.valid_from: r.corr for r in gr.matrix_cell(matrix, 4, 17).collect()}
    assert one == {d: cells[d, 4, 17] for d in (D[60], D[70])}
    above = gr.cells(matrix, F.col("corr") > 0.5).count()
    assert above == sum(v > 0.5 for v in cells.values())
    if fill == "zero":
        want = corr_by_pandas(prices(spark), D[60], 40)
        assert all(v == pytest.approx(want.loc[a, b], abs=1e-12) for (d, a, b), v in cells.items() if d == D[60])


def test_copies_of_a_vector_do_not_grow_with_the_blocks(spark):
    rows = gr.return_rows(prices(spark), gr.snapshot_list(spark, [str(D[60])]), 40)
    units = gr.unit_vectors(rows).cache()
    for block in (2, 1):
        blocks = gr._n_blocks(units, block)
        groups = gr._n_groups(blocks, block)
        assert groups == gr.GROUPS < blocks
        assert gr._tiles(gr._by_hash(units, blocks), groups).count() == 23 * gr.GROUPS
    assert gr._n_groups(10_000, 512) == 10_000 * 512 // gr.GROUP + 1
    # both directions of a cell come from one product
    assert gr.cells(gr.correlation_matrix(rows, block=4))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_files_of_cells_hold_a_value_once_for_both_directions(spark, tmp_path):
    """A cell and the same cell the other way stand close together, and names in runs: about half of the 8 bytes of a value."""
    rng = np.random.default_rng(4)
    values = rng.uniform(-1, 1, 512 * 512).tolist()
    names = [list(range(k, k + 512)) for k in (0, 512)]
    kind = "valid_from date, a bigint, b bigint, src array<bigint>, dst array<bigint>, corr array<double>"
    matrix = spark.createDataFrame([(D[0], 0, 1, *names, values)], kind).coalesce(1)
    gr.cells(matrix).select("src", "dst", "corr").write.parquet(str(tmp_path / "cells"))
    assert sum(f.stat().st_size for f in (tmp_path / "cells").glob("*.parquet")) < 5 * 2 * 512 * 512
    got = spark.read.parquet(str(tmp_path / "cells")).toPandas().set_index(["src", "dst"])["corr"].sort_index()
    want = np.array(values).reshape(512, 512)
    assert len(got) == 2 * 512 * 512 and got.index.is_unique
    assert (got.iloc[: 512 * 512].to_numpy().reshape(512, 512) == want).all()
    assert (got.iloc[512 * 512 :].to_numpy().reshape(512, 512) == want.T).all()


def test_returns_are_not_shuffled_to_the_dates(spark, monkeypatch):
    """The dates of the windows are few whatever the entities, so they go to the returns."""
    plans = []
    monkeypatch.setattr(gr, "stable", lambda df, write=gr.stable: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert gr.return_rows(prices(spark), gr.snapshot_list(spark, [str(D[60])]), 40).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("SortMergeJoin [dt#" in x and "Inner" in x for x in plans[0].splitlines()), plans[0]


def test_graph_of_nothing(spark):
    rows = gr.return_rows(prices(spark), gr.snapshot_list(spark, ["1990-01-01"]), 40)
    for sel in (None, gr.Selection(top_k=2), gr.Selection(threshold=0.1)):
        assert gr.correlate(rows, sel).count() == 0


def test_snapshots_use_only_earlier_rows(spark):
    df = prices(spark)
    changed = df.withColumn("close", F.when(F.col("dt") >= F.lit(D[50]), F.col("close") * (2 + F.rand(1))).otherwise(F.col("close")))
    snap, sel = gr.snapshot_list(spark, [str(D[30]), str(D[50])]), gr.Selection(threshold=0.1)
    a, b = (gr.build_graph(x, snap, sel, 25) for x in (df, changed))
    assert {r.valid_from for r in a.collect()} == {D[30], D[50]}
    assert a.exceptAll(b).count() == 0


def test_lead_lag_of_a_shifted_copy(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.02, 82)
    a, b = 100 * np.cumprod(1 + r[2:]), 100 * np.cumprod(1 + r[:-2])
    df = spark.createDataFrame([(0, D[i], float(a[i])) for i in range(80)] + [(1, D[i], float(b[i])) for i in range(80)], "kdcode bigint, dt date, close double")
    rows = gr.return_rows(df, gr.snapshot_list(spark, [str(D[80])]), 252)
    sel = gr.Selection(top_k=1)
    e = {(x.src, x.dst): x for x in gr.add_lead_lag(gr.rank_edges(gr.correlate(rows, sel), sel), rows).collect()}
    assert e[(0, 1)].lag_norm == pytest.approx(0.4) and e[(0, 1)].lag_corr > 0.95
    assert abs(e[(1, 0)].lag_corr) < 0.5


def test_snapshot_lookup_clamps_to_first(spark):
    snaps = gr.snapshot_list(spark, ["2024-02-01", "2024-03-01"])
    df = spark.createDataFrame([(d,) for d in (dt.date(2024, 1, 5), dt.date(2024, 2, 29), dt.date(2024, 3, 1))], "dt date")
    got = {r.dt: (str(r.valid_from), r.age_days) for r in gr.snapshot_for_dates(df, snaps).collect()}
    assert list(got.values()) == [("2024-02-01", -27), ("2024-02-01", 28), ("2024-03-01", 0)]


def test_sector_peers_of_a_hot_sector(spark):
    s = spark.createDataFrame([(k, "x" if k < 400 else f"s{k}") for k in range(410)], "kdcode bigint, sector string")
    got = gr.sector_edges(s.select("kdcode"), s, 3).toPandas().groupby("src")["dst"].apply(sorted)
    assert len(got) == 400 and got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[300] == [0, 1, 2]


# --- drift, normalisation, sequences ---------------------------------------------------------


def test_drift_match_shift_and_missing(spark):
    rng = np.random.default_rng(0)
    train = spark.createDataFrame([(float(v), 3.0) for v in rng.normal(size=2000)], "x double, c double")
    ref = dr.feature_reference(train, ["x", "c"])
    same = {r.feature: r for r in dr.drift_rows(train, ref, ["x", "c", "new"] if "new" in train.columns else ["x", "c"]).collect()}
    assert same["x"].psi == pytest.approx(0, abs=1e-9) and same["x"].status == "OK" and same["c"].status == "OK"
    moved = train.select((F.col("x") + 1.5).alias("x"), F.lit(1.0).alias("new"))
    rows = dr.drift_rows(moved, ref, ["x", "new"])
    got = {r.feature: r.status for r in rows.collect()}
    assert got == {"x": "ALERT", "new": "NOT_AVAILABLE"}
    assert dr.drift_summary(rows).first().overall == "ALERT"


def test_reference_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.35, 0.0, rng.normal(size=3000))
    ref = dr.feature_reference(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"]).first()
    bins = np.quantile(x, np.linspace(0, 1, 11))
    for i in range(1, 11):
        if bins[i] <= bins[i - 1]:
            bins[i] = bins[i - 1] + 1e-9
    np.testing.assert_allclose(ref.bins, bins, atol=1e-12)
    assert list(ref.counts) == list(np.histogram(x, bins=bins)[0])


def test_rank_gaussian_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300).round(1)
    df = spark.createDataFrame([(i, D[i], float(v)) for i, v in enumerate(x)], "kdcode bigint, dt date, x double")
    got = no.rank_gaussian(df, ["x"], str(D[199])).orderBy("kdcode").toPandas()["x"]
    train = np.sort(x[:200])
    u = np.clip((np.searchsorted(train, x, side="right") + 0.5) / 201, 1e-6, 1 - 1e-6)
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(v) for v in u], atol=1e-12)


def test_windows_exclude_the_label_date(spark):
    rows = [(k, D[i], float(10 * k + i)) for k in range(3) for i in range(10) if not (k == 1 and i == 4)]
    df = spark.createDataFrame(rows, "kdcode bigint, dt date, f double")
    got = {(r.kdcode, r.dt): [v[0] for v in r.seq] for r in sq.sliding_windows(df, ["f"], 3).collect()}
    assert len(got) == 3 * 7
    assert got[(0, D[3])] == [0, 1, 2] and got[(1, D[6])] == [13, 0, 15] and got[(2, D[9])] == [26, 27, 28]
    shuffled = sq.sliding_windows(df.orderBy(F.rand(3)).repartition(7), ["f"], 3)
    assert {(r.kdcode, r.dt): [v[0] for v in r.seq] for r in shuffled.collect()} == got


def test_labels_fill_with_the_mean_of_the_date(spark):
    rows = [(0, D[i], c) for i, c in enumerate((1.0, 2.0, 4.0, 8.0))] + [(1, D[0], 1.0)]
    got = {(r.kdcode, r.dt): r.label for r in sq.forward_labels(spark.createDataFrame(rows, "kdcode bigint, dt date, close double"), 2).collect()}
    assert got[(0, D[0])] == 1.0 and got[(1, D[0])] == 1.0 and got[(0, D[3])] == 0.0


def test_walkforward_periods_do_not_touch(spark):
    df = spark.createDataFrame([(dt.date(2015, 1, 1),), (dt.date(2021, 6, 30),)], "dt date")
    w = sq.walkforward_windows(df, sq.Walkforward(label_t=5))
    assert w.count() == 4 and clean.embargo_check(w, 5).where("valid").count() == 4
    e = sq.walkforward_windows(df, sq.Walkforward(label_t=5, expanding=True, max_windows=2)).collect()
    assert len(e) == 2 and {r.train_start for r in e} == {dt.date(2015, 1, 1)}


def test_haircut_matches_scalar_formula(spark):
    rows = [(i, s, 4.0) for i, s in enumerate((0.3, 1.1, -0.4, 2.5))]
    df = spark.createDataFrame(rows, "strategy_id int, sharpe double, years double")
    nd = NormalDist()
    for method in ("bonferroni", "holm", "bhy"):
        got = {r.strategy_id: r for r in pf.haircut_sharpe(df, "sharpe", "years", "strategy_id", method).collect()}
        ps = {i: 2 * (1 - nd.cdf(abs(s) * 2)) for i, s, _ in rows}
        order = sorted(ps, key=ps.get)
        for i, s, _ in rows:
            k, m = order.index(i) + 1, 4
            f = {"bonferroni": m, "holm": m + 1 - k, "bhy": m * sum(1 / j for j in range(1, m + 1)) / k}[method]
            p = min(ps[i] * f, 1)
            want = 0 if p >= 1 else min(nd.inv_cdf(1 - p / 2) / 2, abs(s))
            assert got[i].haircut_sharpe == pytest.approx(np.sign(s) * want, abs=1e-9)


def test_ledger_replaces_a_date(spark):
    rows = [(1, D[0], 0.1, 0.0, 1.0, 2, 2, 0), (1, D[0], 0.2, None, 0.0, 2, 2, 1), (1, D[1], -0.5, 0.1, 0.0, 0, 2, 0)]
    df = spark.createDataFrame(rows, "strategy_id int, dt date, portfolio_return double, benchmark_return double, turnover double, num_trades int, num_holdings int, seq int")
    a, b = le.performance_ledger(df).orderBy("dt").collect()
    assert (a.equity, a.peak_equity, a.drawdown) == (1.2, 1.2, 0.0)
    assert (b.equity, b.cum_return, b.drawdown, b.excess_return) == (0.6, -0.3, -0.5, -0.6)


def test_nested_runs_flatten(spark):
    df = spark.createDataFrame([((1,), ((2.0, 3.0),), "OK")], "run struct<id:int>, e struct<m:struct<a:double,b:double>>, status string")
    assert ex.flatten(df).columns == ["run.id", "e.m.a", "e.m.b", "status"]


def test_asof_by_key(spark):
    left = spark.createDataFrame([(1, D[5], "x"), (1, D[1], "y"), (2, D[5], "z")], "kdcode bigint, dt date, tag string")
    right = spark.createDataFrame([(1, D[5], 5), (1, D[3], 3), (2, D[6], 6)], "kdcode bigint, dt date, v int")
    got = {r.tag: r.v for r in clean.asof_by_key(left, right).collect()}
    assert got == {"x": 5, "y": None, "z": None}


def test_point_in_time_overlap(spark):
    df = spark.createDataFrame([(1, D[5]), (1, D[50])], "kdcode bigint, dt date")
    u = spark.createDataFrame([(1, D[0], D[10]), (1, D[4], D[9])], "kdcode bigint, valid_from date, valid_to date")
    assert clean.point_in_time(df, u).count() == 1
    assert clean.point_in_time(df, u, dedupe=False).count() == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    from rankloom.sources.panel import fingerprint

    df = spark.createDataFrame([(k, D[k % 7], float(k)) for k in range(50)], "kdcode bigint, dt date, close double")
    a = fingerprint(df).first()
    assert fingerprint(df.orderBy(F.rand(2)).repartition(5)).first() == a and (a.n_rows, a.first_dt, a.last_dt) == (50, D[0], D[6])
    assert fingerprint(df.withColumn("close", F.when(F.col("kdcode") == 3, 0.5).otherwise(F.col("close")))).first().row_hash != a.row_hash


def test_daily_report_holds_the_date(spark):
    import json

    rows = [(1, D[0], 0.1, 0.0, 1.0, 2, 2, 0), (1, D[1], -0.5, 0.1, 0.0, 0, 2, 0)]
    daily = spark.createDataFrame(rows, "strategy_id int, dt date, portfolio_return double, benchmark_return double, turnover double, num_trades int, num_holdings int, seq int")
    ledger = le.performance_ledger(daily)
    target = spark.createDataFrame([(1, 20, 0.5), (1, 10, 0.5)], "strategy_id int, kdcode bigint, weight double")
    orders = spark.createDataFrame([(1, 30, "SELL")], "strategy_id int, kdcode bigint, side string")
    doc = json.loads(le.daily_report(ledger, pf.recent_stats(ledger), target, orders, str(D[1])).first().report)
    assert doc["performance"]["portfolio_return"] == -0.5 and doc["rolling"]["num_days"] == 2
    assert [h["kdcode"] for h in doc["holdings"]] == [10, 20] and doc["orders"][0]["side"] == "SELL"


def test_p_value_and_back(spark):
    df = spark.createDataFrame([(1, 0.5, 4.0), (2, -1.0, 1.0), (3, 0.0, 4.0), (4, 1.0, 0.0)], "s int, sharpe double, years double")
    got = {r.s: r for r in pf.add_significance(df, "sharpe", "years").withColumn("back", pf.t_of_p(F.col("p_value"))).collect()}
    nd = NormalDist()
    for i, t in ((1, 1.0), (2, -1.0), (3, 0.0), (4, 0.0)):
        assert got[i].t_stat == pytest.approx(t) and got[i].p_value == pytest.approx(2 * (1 - nd.cdf(abs(t))))
        assert got[i].back == pytest.approx(abs(t), abs=1e-9)


def test_fingerprint_keeps_values_apart(spark):
    from rankloom.sources.panel import fingerprint

    def of(*rows):
        return fingerprint(spark.createDataFrame(rows, "a string, b string, dt date")).first().row_hash

    assert of(("1';b=1'2", "3", D[0])) != of(("1", "2';b=1'3", D[0])) and of(("1';b='2", "3", D[0])) != of(("1", "2';b='3", D[0]))
    assert of((None, "x", D[0])) != of(("NULL", "x", D[0])) and of(("", None, D[0])) != of((None, "", D[0]))


def test_report_rows(spark):
    ledger = spark.createDataFrame([(1, D[0], 0.1, 3), (1, D[1], -0.2, 4), (2, D[0], 0.3, 5)], "strategy_id int, dt date, net_return double, num_trades bigint")
    recent = spark.createDataFrame([(1, 0.5)], "strategy_id int, win_rate double")
    target = spark.createDataFrame([(1, 7, D[1], 0.5, 2, 1.5, D[0])], "strategy_id int, kdcode bigint, dt date, weight double, rank bigint, score double, entry_date date")
    orders = spark.createDataFrame([(1, 7, D[1], "BUY", "new_entry")], "strategy_id int, kdcode bigint, dt date, side string, reason string")
    got = {(r.section, r.kdcode, r["item"]): (r.value, r.note) for r in le.report_rows(ledger, recent, target, orders, str(D[1])).collect()}
    assert got == {
        ("performance", None, "net_return"): (-0.2, None), ("performance", None, "num_trades"): (4.0, None), ("rolling", None, "win_rate"): (0.5, None),
        ("holdings", "7", "weight"): (0.5, str(D[0])), ("holdings", "7", "rank"): (2.0, str(D[0])), ("holdings", "7", "score"): (1.5, str(D[0])), ("orders", "7", "BUY"): (None, "new_entry"),
    }


def test_harmonic_number_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pf, "BLOCK", 4)
    for m in (0, 1, 4, 9):
        got = spark.range(1).select(pf.harmonic_number(spark.range(m)).alias("c")).first().c
        assert got == (None if m == 0 else pytest.approx(sum(1 / i for i in range(1, m + 1))))
