"""Performance of the back-tested strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.normal import cdf_sql, ppf_sql
from rankloom.operators import evaluate as ev
from rankloom.operators import performance as pf
from rankloom.operators import portfolio as po
from rankloom.plans import q_evaluate  # noqa: F401  (shared fragments)
from rankloom.plans import testdata as td
from rankloom.plans.q_portfolio import ranked_run, run
from rankloom.plans.registry import check_sql, query, r, rounded, share, sig, significant
from rankloom.session import new_path, stable
from rankloom.sources import sinks

YEAR = 12

share(
    "curve",
    """SELECT *, value / max(value) OVER (PARTITION BY strategy_id ORDER BY entry_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM
    (SELECT *, product(1 + net_return) OVER (PARTITION BY strategy_id ORDER BY entry_date ROWS UNBOUNDED PRECEDING) AS value,
    product(1 + benchmark_return) OVER (PARTITION BY strategy_id ORDER BY entry_date ROWS UNBOUNDED PRECEDING) AS bm_value FROM bt_daily)""",
    "bt_daily",
)
share(
    "metrics",
    f"""SELECT *, coalesce("ARR" / nullif(abs("AVoL"), 0), 0) AS "ASR", coalesce("ARR" / nullif(abs("MDD"), 0), 0) AS "CR" FROM (SELECT strategy_id,
    power(product(1 + net_return), {YEAR}.0::DOUBLE / count(*)) - 1 AS "ARR", coalesce(stddev_samp(net_return), 0) * sqrt({YEAR}) AS "AVoL", min(drawdown) AS "MDD",
    product(1 + net_return) - 1 AS total_return, count(*) AS num_days FROM curve GROUP BY 1)""",
    "curve",
)


def sweep(spark, sf):
    return run(spark, sf).daily


def metrics(spark, sf):
    return pf.return_metrics(sweep(spark, sf), order="entry_date", value="net_return", year=YEAR)


@query(
    "p1_annual_return",
    check_sql("metrics", f'SELECT strategy_id, {sig(chr(34) + "ARR" + chr(34))} AS "ARR", {sig("total_return")} AS total_return, num_days FROM metrics'),
)
def p1(spark, sf):
    return significant(metrics(spark, sf).select("strategy_id", "ARR", "total_return", "num_days"), "ARR", "total_return")


@query("p2_volatility", check_sql("metrics", 'SELECT strategy_id, ' + r('"AVoL"') + ' AS "AVoL" FROM metrics'))
def p2(spark, sf):
    return rounded(metrics(spark, sf).select("strategy_id", "AVoL"), "AVoL")


@query("p3_drawdown", check_sql("curve", f"SELECT strategy_id, entry_date, {sig('value')} AS cum_value, {r('drawdown')} AS drawdown FROM curve"))
def p3(spark, sf):
    d = pf.drawdowns(sweep(spark, sf), ["strategy_id"], "entry_date", "net_return").drop("r")
    return rounded(significant(d, "cum_value"), "drawdown")


@query(
    "p4_ratios",
    check_sql("metrics", "SELECT strategy_id, " + ", ".join(f'{sig(chr(34) + c + chr(34))} AS "{c}"' for c in ("MDD", "ASR", "CR")) + " FROM metrics"),
)
def p4(spark, sf):
    return significant(metrics(spark, sf).select("strategy_id", "MDD", "ASR", "CR"), "MDD", "ASR", "CR")


share(
    "ir",
    """SELECT strategy_id, coalesce(avg(portfolio_return - benchmark_return) / nullif(stddev_samp(portfolio_return - benchmark_return), 0), 0) AS ir FROM cal GROUP BY 1""",
    "cal",
)


def aligned(spark, sf, daily):
    return po.calendar_returns(daily, po.benchmark(po.open_to_open(td.bars_m(spark, sf))))


@query("p5_information_ratio", check_sql("ir", f'SELECT strategy_id, {r("ir")} AS "IR" FROM ir'))
def p5(spark, sf):
    return rounded(pf.information_ratio(aligned(spark, sf, sweep(spark, sf))), "IR")


_p6_big = (
    "ARR", "ASR", "CR", "total_return", "gross_ARR", "gross_total_return", "total_return_calendar_aligned", "benchmark_return",
    "excess_return", "cost_drag_ARR", "mse", "rmse", "mae",
)
_p6_small = ("AVoL", "MDD", "IR", "total_transaction_cost", "avg_daily_turnover", "avg_daily_cost_bps")
share(
    "summary",
    f"""SELECT m.*, g.*, c.*, ir.ir AS "IR", e.mse, e.rmse, e.mae, c.total_return_calendar_aligned - c.benchmark_return AS excess_return, g."gross_ARR" - m."ARR" AS "cost_drag_ARR" FROM metrics m
    JOIN (SELECT strategy_id AS s1, power(product(1 + gross_return), {YEAR}.0::DOUBLE / count(*)) - 1 AS "gross_ARR", product(1 + gross_return) - 1 AS gross_total_return, sum(cost) AS total_transaction_cost,
      avg(turnover) AS avg_daily_turnover, avg(cost) * 10000 AS avg_daily_cost_bps, sum(num_trades)::BIGINT AS total_trades, min(entry_date) AS start_date, max(entry_date) AS end_date FROM bt_daily GROUP BY 1) g ON g.s1 = m.strategy_id
    JOIN (SELECT strategy_id AS s2, product(1 + portfolio_return) - 1 AS total_return_calendar_aligned, product(1 + benchmark_return) - 1 AS benchmark_return FROM cal GROUP BY 1) c ON c.s2 = m.strategy_id
    JOIN ir ON ir.strategy_id = m.strategy_id JOIN plain p ON p.strategy_id = m.strategy_id JOIN errors e ON e.model_id = p.model_id""",
    "metrics bt_daily cal ir plain errors",
)


@query(
    "p6_summary",
    check_sql(
        "summary",
        "SELECT strategy_id, num_days, total_trades, start_date, end_date, " + ", ".join(f'{sig(chr(34) + c + chr(34))} AS "{c}"' for c in _p6_big)
        + ", " + ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in _p6_small) + " FROM summary",
    ),
)
def p6(spark, sf):
    daily = stable(sweep(spark, sf))
    e = ev.error_metrics(td.pairs(spark, sf)).drop("n_pairs")
    errors = td.strategies(spark).select("strategy_id", "model_id").join(e, "model_id").drop("model_id")
    df = pf.summary(daily, aligned(spark, sf, daily), errors, YEAR)
    return rounded(significant(df, *_p6_big), *_p6_small)


share(
    "significance",
    f"""SELECT *, 2 * (1 - {cdf_sql('abs(t_stat)')}) AS p_value FROM
    (SELECT *, CASE WHEN years > 0 THEN "ASR" * sqrt(years) ELSE 0 END AS t_stat FROM (SELECT *, num_days / {YEAR}.0::DOUBLE AS years FROM metrics))""",
    "metrics",
)


def t_sql(p: str) -> str:
    return f"(CASE WHEN {p} >= 1 THEN 0 WHEN {p} <= 0 THEN 'inf'::DOUBLE ELSE {ppf_sql(f'(1 - {p} / 2)')} END)"


@query(
    "p7_significance",
    check_sql("significance", f"SELECT strategy_id, {r('t_stat')} AS t_stat, {r('p_value')} AS p_value, {r(t_sql('round(p_value, 6)'), 5)} AS t_back FROM significance"),
)
def p7(spark, sf):
    m = metrics(spark, sf).withColumn("years", F.col("num_days") / float(YEAR))
    out = rounded(pf.add_significance(m, "ASR", "years").select("strategy_id", "t_stat", "p_value"), "t_stat", "p_value")
    return rounded(out.withColumn("t_back", pf.t_of_p(F.col("p_value"))), "t_back", digits=5)


share(
    "adjusted",
    f"""SELECT *, CASE WHEN num_tests <= 1 THEN p_value ELSE least(p_value * num_tests, 1) END AS p_bonferroni,
    CASE WHEN num_tests <= 1 THEN p_value ELSE least(p_value * (num_tests + 1 - p_rank), 1) END AS p_holm,
    CASE WHEN num_tests <= 1 THEN p_value ELSE least(p_value * num_tests * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) + 1 FROM significance)) x(i)) / p_rank, 1) END AS p_bhy
    FROM (SELECT *, row_number() OVER (ORDER BY p_value, strategy_id) AS p_rank, count(*) OVER () AS num_tests FROM significance)""",
    "significance",
)


@query(
    "p8_adjusted_p_values",
    check_sql(
        "adjusted",
        "SELECT strategy_id, p_rank, num_tests, " + ", ".join(f"{r(c)} AS {c}" for c in ("p_value", "p_bonferroni", "p_holm", "p_bhy")) + " FROM adjusted",
    ),
)
def p8(spark, sf):
    m = metrics(spark, sf).withColumn("years", F.col("num_days") / float(YEAR))
    p = pf.add_significance(m, "ASR", "years").select("strategy_id", "p_value")
    return rounded(pf.adjust_p_values(p, "p_value", "strategy_id"), "p_value", "p_bonferroni", "p_holm", "p_bhy")


@query(
    "p9_haircut_sharpe",
    check_sql(
        "adjusted",
        f"""WITH b AS (SELECT *, CASE WHEN years > 0 THEN {t_sql('p_bhy')} / sqrt(years) ELSE 0 END AS back FROM adjusted),
    h AS (SELECT *, CASE WHEN "ASR" < 0 THEN -greatest(0, least(back, abs("ASR"))) ELSE greatest(0, least(back, abs("ASR"))) END AS haircut FROM b)
    SELECT strategy_id, {r('t_stat')} AS t_stat, {r('p_value')} AS p_value, {r('p_bhy')} AS p_bhy, {r('haircut', 5)} AS haircut_sharpe,
    {r('coalesce((abs("ASR") - abs(haircut)) * 100 / nullif(abs("ASR"), 0), 0)', 3)} AS haircut_pct, p_bhy < 0.05 AS is_significant FROM h""",
    ),
)
def p9(spark, sf):
    m = metrics(spark, sf).withColumn("years", F.col("num_days") / float(YEAR))
    out = pf.haircut_sharpe(m, "ASR", "years", "strategy_id").select(
        "strategy_id", "t_stat", "p_value", "p_bhy", "haircut_sharpe", "haircut_pct", "is_significant"
    )
    return rounded(rounded(rounded(out, "t_stat", "p_value", "p_bhy"), "haircut_sharpe", digits=5), "haircut_pct", digits=3)


@query(
    "p10_cumulative_performance",
    check_sql(
        "curve",
        f"""SELECT strategy_id, entry_date, {sig('value')} AS portfolio_value, {sig('bm_value')} AS benchmark_value, {sig('value / bm_value')} AS relative_performance, {r('drawdown')} AS portfolio_drawdown FROM curve""",
    ),
)
def p10(spark, sf):
    df = pf.cumulative_performance(sweep(spark, sf))
    return rounded(significant(df, "portfolio_value", "benchmark_value", "relative_performance"), "portfolio_drawdown")


_p11 = ("portfolio_return", "portfolio_volatility", "benchmark_return", "benchmark_volatility", "excess_return", "avg_excess_return")


@query(
    "p11_period_performance",
    check_sql(
        "bt_daily",
        f"""SELECT strategy_id, CAST(date_trunc('quarter', entry_date) AS DATE) AS period, {r('sum(net_return)')} AS portfolio_return, {r('stddev_samp(net_return)')} AS portfolio_volatility,
    count(net_return) AS trading_days, {r('sum(benchmark_return)')} AS benchmark_return, {r('stddev_samp(benchmark_return)')} AS benchmark_volatility,
    {r('sum(net_return - benchmark_return)')} AS excess_return, {r('avg(net_return - benchmark_return)')} AS avg_excess_return FROM bt_daily GROUP BY 1, 2""",
    ),
)
def p11(spark, sf):
    return rounded(pf.period_performance(sweep(spark, sf), "QUARTER"), *_p11)


share("attrib", "SELECT *, sum(contribution) OVER (PARTITION BY strategy_id, entry_date) AS day_sum FROM holdings", "holdings")


@query(
    "p12_attribution",
    check_sql(
        "attrib",
        f"""SELECT strategy_id, tranche_id, entry_date, pred_date, kdcode, {r('stock_return')} AS stock_return, {r('weight')} AS weight, {r('contribution')} AS contribution,
    {sig('CASE WHEN abs(day_sum) > 1e-12 THEN contribution / day_sum * 100 END')} AS pct_of_portfolio_return FROM attrib""",
    ),
)
def p12(spark, sf):
    df = pf.attribution(po.holdings_records(*ranked_run(spark, sf)))
    return significant(rounded(df, "stock_return", "weight", "contribution"), "pct_of_portfolio_return")


@query(
    "p13_composition",
    check_sql(
        "holdings journal",
        f"""SELECT h.strategy_id, h.tranche_id, h.entry_date, h.pred_date, h.kdcode, h.rank, {r('h.score')} AS score, {r('h.weight')} AS weight, {r('h.stock_return')} AS stock_return,
    {r('h.contribution')} AS contribution, CASE WHEN EXISTS (SELECT 1 FROM journal j WHERE j.action = 'BUY' AND j.strategy_id = h.strategy_id AND j.date = h.entry_date AND j.kdcode = h.kdcode) THEN 'NEW' ELSE 'HELD' END AS status
    FROM holdings h""",
    ),
)
def p13(spark, sf):
    bt, ranked = ranked_run(spark, sf)
    df = pf.composition(po.holdings_records(bt, ranked), po.trade_journal(bt, ranked))
    return rounded(df, "score", "weight", "stock_return", "contribution")


@query(
    "p14_holdings_summary",
    check_sql(
        "holdings",
        f"""SELECT strategy_id, kdcode, count(stock_return) AS times_held, {r('avg(score)')} AS avg_score, {r('avg(stock_return)')} AS avg_return, {r('sum(contribution)')} AS total_contribution,
    {r('avg((stock_return > 0)::INTEGER)')} AS win_rate FROM holdings GROUP BY 1, 2""",
    ),
)
def p14(spark, sf):
    df = pf.holdings_summary(po.holdings_records(*ranked_run(spark, sf)))
    return rounded(df, "avg_score", "avg_return", "total_contribution", "win_rate")


_p15 = ("ARR", "AVol", "MDD", "ASR", "CR", "IR", "Total_Return")


@query(
    "p15_legacy_metrics",
    check_sql(
        "curve",
        """WITH m AS (SELECT strategy_id, power(product(1 + net_return), 252.0::DOUBLE / count(*)) - 1 AS "ARR", stddev_pop(net_return) * sqrt(252) AS "AVol", min(drawdown) AS "MDD",
      avg(net_return) / nullif(stddev_pop(net_return), 0) * sqrt(252) AS "IR", product(1 + net_return) - 1 AS "Total_Return", count(*) AS "Num_Days" FROM curve GROUP BY 1),
    x AS (SELECT *, coalesce("ARR" / nullif("AVol", 0), 0) AS "ASR", coalesce("ARR" / nullif(abs("MDD"), 0), 0) AS "CR" FROM m) SELECT strategy_id, "Num_Days", """ + ", ".join(f'{sig(chr(34) + c + chr(34))} AS "{c}"' for c in _p15) + " FROM x",
    ),
)
def p15(spark, sf):
    return significant(pf.legacy_metrics(sweep(spark, sf), order="entry_date", value="net_return"), *_p15)


_p16 = ("rolling_vol_ann", "sharpe_proxy", "max_drawdown", "win_rate", "avg_daily_return")


@query(
    "p16_recent_stats",
    check_sql(
        "curve",
        f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY entry_date DESC) AS k FROM curve)
    SELECT strategy_id, {r('stddev_samp(net_return) FILTER (k <= 20) * sqrt(252)')} AS rolling_vol_ann, {r('avg(net_return) FILTER (k <= 20) / stddev_samp(net_return) FILTER (k <= 20) * sqrt(252)')} AS sharpe_proxy,
    {r('min(drawdown)')} AS max_drawdown, count(*) AS num_days, {r('avg((net_return > 0)::INTEGER)')} AS win_rate, {r('avg(net_return)')} AS avg_daily_return FROM k GROUP BY 1""",
    ),
)
def p16(spark, sf):
    d = pf.drawdowns(sweep(spark, sf), ["strategy_id"], "entry_date", "net_return")
    ledger = d.select("strategy_id", F.col("entry_date").alias("dt"), F.col("r").alias("net_return"), "drawdown")
    return rounded(pf.recent_stats(ledger), *_p16)


share(
    "yearly",
    f"""SELECT strategy_id, yr, "ARR", "ARR" / nullif(vol, 0) AS "ASR" FROM (SELECT strategy_id, year(entry_date) AS yr,
    power(product(1 + net_return), {YEAR}.0::DOUBLE / count(*)) - 1 AS "ARR", stddev_samp(net_return) * sqrt({YEAR}) AS vol FROM bt_daily GROUP BY 1, 2 HAVING count(*) > 1)""",
    "bt_daily",
)


def yearly(spark, sf):
    d = sweep(spark, sf).withColumn("yr", F.year("entry_date"))
    m = pf.return_metrics(d, by=("strategy_id", "yr"), order="entry_date", value="net_return", year=YEAR)
    return m.where("num_days > 1").select("strategy_id", "yr", "ARR", "ASR")


_p17 = ("mean", "std", "min", "max", "cv", "range")


@query(
    "p17_consistency",
    check_sql(
        "yearly",
        """WITH u AS (SELECT strategy_id, 'ARR' AS metric, "ARR" AS v FROM yearly UNION ALL SELECT strategy_id, 'ASR', "ASR" FROM yearly),
    s AS (SELECT strategy_id, metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, stddev_pop(v) / abs(avg(v)) AS cv, max(v) - min(v) AS range FROM u GROUP BY 1, 2)
    SELECT strategy_id, metric, """ + ", ".join(f'{sig(chr(34) + c + chr(34))} AS "{c}"' for c in _p17) + " FROM s",
    ),
)
def p17(spark, sf):
    return significant(pf.consistency(yearly(spark, sf), ["strategy_id"], ["ARR", "ASR"]), *_p17)


@query(
    "p17_is_consistent",
    check_sql(
        "yearly",
        f"""WITH s AS (SELECT strategy_id, stddev_pop("ARR") / abs(avg("ARR")) AS a, stddev_pop("ASR") / abs(avg("ASR")) AS b FROM yearly GROUP BY 1)
    SELECT strategy_id, {sig('a')} AS arr_cv, {sig('b')} AS asr_cv, a < 0.5 AND b < 0.5 AS is_consistent FROM s""",
    ),
)
def p17_flag(spark, sf):
    rows = pf.consistency(yearly(spark, sf), ["strategy_id"], ["ARR", "ASR"])
    return significant(pf.is_consistent(rows, ["strategy_id"]), "arr_cv", "asr_cv")


# Of some of the tables every row is compared: date column, name column, columns.
_S15 = {
    "daily_returns": ("entry_date", None, ["gross_return", "net_return", "benchmark_return", "turnover", "num_trades", "n_held"]),
    "daily_holdings": ("entry_date", "kdcode", ["tranche_id", "weight", "stock_return", "contribution"]),
    "trade_journal": ("date", "kdcode", ["tranche_id", "rank", "score"]),
}
_s15_source = {"daily_returns": "bt_daily", "daily_holdings": "holdings", "trade_journal": "journal"}


@query(
    "s15_backtest_outputs",
    check_sql(
        "bt_daily holdings journal",
        """WITH n AS (SELECT 'daily_returns' AS table_name, count(*) AS n_rows FROM bt_daily UNION ALL SELECT 'cumulative_performance', count(*) FROM bt_daily
    UNION ALL SELECT 'monthly_performance', count(DISTINCT (strategy_id, date_trunc('month', entry_date))) FROM bt_daily UNION ALL SELECT 'daily_holdings', count(*) FROM holdings
    UNION ALL SELECT 'return_attribution', count(*) FROM holdings UNION ALL SELECT 'portfolio_composition', count(*) FROM holdings
    UNION ALL SELECT 'holdings_summary', count(DISTINCT (strategy_id, kdcode)) FROM holdings UNION ALL SELECT 'trade_journal', count(*) FROM journal)
    SELECT table_name, NULL::INTEGER AS strategy_id, NULL::DATE AS dt, NULL::VARCHAR AS kdcode, 'rows' AS item, n_rows::DOUBLE AS value FROM n"""
        + "".join(
            f" UNION ALL SELECT '{t}', strategy_id, {date}, {f'{code}::VARCHAR' if code else 'NULL'}, '{c}', {r(c)} FROM {_s15_source[t]}"
            for t, (date, code, columns) in _S15.items()
            for c in columns
        ),
    ),
)
def s15(spark, sf):
    """All tables of a back-test written and read back: rows per table, and the cells of three of them."""
    bt, ranked = ranked_run(spark, sf)
    # Several tables come from each of these: K names a day, looked up once in the panel and the ranks.
    daily, holdings, trades = stable(bt.daily), stable(po.holdings_records(bt, ranked)), stable(po.trade_journal(bt, ranked))
    tables = {
        "daily_returns": daily,
        "cumulative_performance": pf.cumulative_performance(daily),
        "monthly_performance": pf.period_performance(daily),
        "daily_holdings": holdings,
        "return_attribution": pf.attribution(holdings),
        "portfolio_composition": pf.composition(holdings, trades),
        "holdings_summary": pf.holdings_summary(holdings),
        "trade_journal": trades,
    }
    path = sinks.write_backtest(tables, new_path(spark, "backtest"))
    counts = sinks.output_listing(spark, path, list(tables)).select(
        "table_name", F.lit(None).cast("int").alias("strategy_id"), F.lit(None).cast("date").alias("dt"), F.lit(None).cast("string").alias("kdcode"),
        F.lit("rows").alias("item"), F.col("n_rows").cast("double").alias("value"),
    )
    return counts.unionByName(rounded(sinks.output_cells(spark, path, _S15), "value"))
