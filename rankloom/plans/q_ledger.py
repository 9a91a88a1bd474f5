"""T-a to T-k: paper-trade tables of the gated strategies at one decision date."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import ledger as le
from rankloom.operators import performance as pf
from rankloom.operators import portfolio as po
from rankloom.plans import testdata as td
from rankloom.plans.q_performance import metrics
from rankloom.plans.q_portfolio import CUR, PREV, gate_inputs, run
from rankloom.plans.registry import check_sql, query, r, rounded, share, sig, significant
from rankloom.session import stable
from rankloom.sources.panel import index_series

FILL, NEXT = "2000-07-01", "2000-08-01"

share(
    "target",
    f"""SELECT g.strategy_id, g.kdcode, DATE '{CUR}' AS dt, {r('1.0 / count(*) OVER (PARTITION BY g.strategy_id)')} AS weight, c.rank, {r('c.score', 5)} AS score,
    CASE WHEN g.status = 'survivor' THEN DATE '{PREV}' ELSE coalesce((SELECT DATE '{PREV}' FROM prev_ranks p WHERE p.model_id = s.model_id AND p.kdcode = g.kdcode AND p.rank <= s.top_k), DATE '{CUR}') END AS entry_date
    FROM gate g JOIN gated s ON s.strategy_id = g.strategy_id LEFT JOIN cur_ranks c ON c.model_id = s.model_id AND c.kdcode = g.kdcode WHERE g.status IN ('survivor', 'entry')""",
    "gate gated cur_ranks prev_ranks",
)
share(
    "orders_t",
    f"""SELECT strategy_id, kdcode, DATE '{CUR}' AS dt, CASE WHEN status = 'entry' THEN 'BUY' ELSE 'SELL' END AS side,
    CASE status WHEN 'exit' THEN 'rank_drop ' || prev_rank || '->' || curr_rank || ' (+' || rank_drop || ')' WHEN 'dropped' THEN 'dropped_from_universe' ELSE 'new_entry' END AS reason
    FROM gate WHERE status <> 'survivor'""",
    "gate",
)


class Decision:
    """One decision of the gated strategies with everything it was made from."""

    def __init__(self, spark, sf):
        self.ranked, self.holdings, prev, self.strategies = gate_inputs(spark, sf)
        self.rows = stable(po.rank_drop_step(self.ranked, self.holdings, prev, self.strategies))

    def target(self):
        return le.target_portfolio(self.rows, self.ranked, self.strategies, self.holdings, CUR)

    def orders(self):
        return le.orders(self.rows, self.holdings, CUR)


def target(spark, sf):
    return Decision(spark, sf).target()


def order_rows(spark, sf):
    return Decision(spark, sf).orders()


@query("ta_target_portfolio", check_sql("target", "SELECT * FROM target"))
def ta(spark, sf):
    return rounded(rounded(target(spark, sf), "weight"), "score", digits=5)


@query("tb_orders", check_sql("orders_t", "SELECT * FROM orders_t"))
def tb(spark, sf):
    return order_rows(spark, sf)


share("fills_t", f"SELECT o.strategy_id, o.kdcode, DATE '{FILL}' AS dt, o.side, {r('b.open', 4)} AS fill_price, o.reason FROM orders_t o LEFT JOIN bars_m b ON b.kdcode = o.kdcode AND b.dt = DATE '{FILL}'", "orders_t bars_m")


@query("tc_fills", check_sql("fills_t", "SELECT * FROM fills_t"))
def tc(spark, sf):
    return le.fills(order_rows(spark, sf), td.bars_m(spark, sf), FILL)


share(
    "posret",
    f"""SELECT t.strategy_id, t.kdcode, DATE '{NEXT}' AS dt, t.weight, t.entry_date, a.open AS open_prev, b.open AS open_curr, b.open / a.open - 1 AS stock_return
    FROM target t JOIN bars_m a ON a.kdcode = t.kdcode AND a.dt = DATE '{FILL}' JOIN bars_m b ON b.kdcode = t.kdcode AND b.dt = DATE '{NEXT}'""",
    "target bars_m",
)


@query(
    "td_position_returns",
    check_sql(
        "posret",
        f"""SELECT strategy_id, kdcode, dt, weight, entry_date, {r('open_prev', 4)} AS open_prev, {r('open_curr', 4)} AS open_curr, {r('stock_return')} AS stock_return,
    {r('stock_return * weight')} AS contribution FROM posret""",
    ),
)
def td_returns(spark, sf):
    df = le.position_returns(target(spark, sf), td.bars_m(spark, sf), NEXT, FILL)
    return rounded(df, "weight", "stock_return", "contribution")


@query("td_portfolio_return", check_sql("posret", f"SELECT strategy_id, dt, {r('avg(stock_return)')} AS portfolio_return, count(*) AS num_stocks FROM posret GROUP BY 1, 2"))
def td_portfolio(spark, sf):
    return rounded(le.portfolio_return(le.position_returns(target(spark, sf), td.bars_m(spark, sf), NEXT, FILL)), "portfolio_return")


@query(
    "te_benchmark_return",
    f"""WITH i AS (SELECT CAST(o_orderdate AS DATE) AS dt, arg_max(o_totalprice, o_orderkey) AS open FROM orders GROUP BY 1)
    SELECT dt, {r('open / lag(open) OVER (ORDER BY dt) - 1')} AS benchmark_return FROM i""",
)
def te(spark, sf):
    raw = td.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("dt"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("seq")
    )
    return rounded(le.benchmark_return(index_series(raw, "seq", "1990-01-01", "2010-12-31"), "INDEX"), "benchmark_return")


def ledger_input(spark, sf):
    """Booked days of all strategies, each preceded by a stale first version."""
    d = stable(
        run(spark, sf).daily.select(
            "strategy_id", F.col("entry_date").alias("dt"), F.col("gross_return").alias("portfolio_return"), "benchmark_return",
            "turnover", "num_trades", F.col("n_held").alias("num_holdings"),
        )
    )
    stale = d.withColumn("portfolio_return", F.lit(0.5)).withColumn("seq", F.lit(0))
    return d.withColumn("seq", F.lit(1)).unionByName(stale)


_l = "PARTITION BY strategy_id ORDER BY dt ROWS UNBOUNDED PRECEDING"
share(
    "ledger",
    f"""WITH d AS (SELECT strategy_id, entry_date AS dt, gross_return AS portfolio_return, benchmark_return, turnover, num_trades, n_held AS num_holdings, turnover * 0.001 * 2 AS est_cost FROM bt_daily),
    n AS (SELECT *, portfolio_return - est_cost AS net_return, portfolio_return - benchmark_return AS excess_return FROM d),
    c AS (SELECT *, sum(net_return) OVER ({_l}) AS cum_return, sum(benchmark_return) OVER ({_l}) AS cum_benchmark, product(1 + net_return) OVER ({_l}) AS equity FROM n),
    p AS (SELECT *, greatest(1, max(equity) OVER ({_l})) AS peak_equity FROM c) SELECT *, equity / peak_equity - 1 AS drawdown FROM p""",
    "bt_daily",
)
_small = ("portfolio_return", "net_return", "benchmark_return", "excess_return", "cum_return", "cum_benchmark", "drawdown", "est_cost")


@query(
    "tf_performance_ledger",
    check_sql(
        "ledger",
        "SELECT strategy_id, dt, num_trades, num_holdings, " + ", ".join(f"{r(c)} AS {c}" for c in _small)
        + f", {sig('equity')} AS equity, {sig('peak_equity')} AS peak_equity, {r('turnover', 4)} AS turnover FROM ledger",
    ),
)
def tf(spark, sf):
    df = le.performance_ledger(ledger_input(spark, sf), digits=None)
    return rounded(rounded(significant(df, "equity", "peak_equity"), *_small), "turnover", digits=4)


@query(
    "tg_upsert_trades",
    check_sql(
        "fills_t orders_t",
        f"""SELECT strategy_id, kdcode, dt, side, fill_price FROM fills_t UNION ALL SELECT strategy_id, kdcode, DATE '{CUR}', side, 1::DOUBLE FROM orders_t""",
    ),
)
def tg(spark, sf):
    o = stable(order_rows(spark, sf))
    new = le.fills(o, td.bars_m(spark, sf), FILL).select("strategy_id", "kdcode", "dt", "side", "fill_price")
    old = o.select("strategy_id", "kdcode", "dt", "side", F.lit(1.0).alias("fill_price"))
    wrong = new.withColumn("fill_price", F.lit(-1.0))
    return le.upsert_trades(old.unionByName(wrong), new)


@query(
    "th_active_positions",
    check_sql(
        "target fills_t",
        "SELECT t.strategy_id, t.kdcode, t.weight, t.entry_date, f.fill_price FROM target t LEFT JOIN fills_t f ON f.strategy_id = t.strategy_id AND f.kdcode = t.kdcode AND f.side = 'BUY'",
    ),
)
def th(spark, sf):
    d = Decision(spark, sf)
    return rounded(le.active_positions(d.target(), le.fills(d.orders(), td.bars_m(spark, sf), FILL)), "weight")


@query("ti_pending_dates", check_sql("ticks", "SELECT DISTINCT dt FROM ticks WHERE dt > (SELECT max(dt) FROM ticks WHERE dt <= DATE '2001-08-15')"))
def ti(spark, sf):
    t = td.ticks(spark, sf)
    return le.pending_dates(t, t.where("dt <= DATE '2001-08-15'").select("dt"))


@query(
    "tj_compare_runs",
    check_sql(
        "metrics",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS metric, {sig(f'max("{c}") FILTER (strategy_id = 2)')} AS value_a, {sig(f'max("{c}") FILTER (strategy_id = 4)')} AS value_b,
    {sig(f'max("{c}") FILTER (strategy_id = 2) - max("{c}") FILTER (strategy_id = 4)')} AS delta FROM metrics"""
            for c in ("ARR", "AVoL", "MDD", "ASR")
        ),
    ),
)
def tj(spark, sf):
    df = le.compare_runs(metrics(spark, sf), "strategy_id", 2, 4, ["ARR", "AVoL", "MDD", "ASR"])
    return significant(df, "value_a", "value_b", "delta")


_rolling = ("rolling_vol_ann", "sharpe_proxy", "max_drawdown", "win_rate", "avg_daily_return")


def _figures(table: str, section: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT strategy_id, DATE '{FILL}' AS dt, '{section}' AS section, NULL::VARCHAR AS kdcode, '{c}' AS item, ({e})::DOUBLE AS value, NULL::VARCHAR AS note FROM {table}" for c, e in columns.items())


@query(
    "tk_daily_report",
    check_sql(
        "ledger target orders_t",
        f"""WITH today AS (SELECT * FROM ledger WHERE dt = DATE '{FILL}'),
    k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY dt DESC) AS k FROM ledger),
    recent AS (SELECT strategy_id, stddev_samp(net_return) FILTER (k <= 20) * sqrt(252) AS rolling_vol_ann, avg(net_return) FILTER (k <= 20) / stddev_samp(net_return) FILTER (k <= 20) * sqrt(252) AS sharpe_proxy,
      min(drawdown) AS max_drawdown, count(*) AS num_days, avg((net_return > 0)::INTEGER) AS win_rate, avg(net_return) AS avg_daily_return FROM k GROUP BY 1)
    """
        + _figures("today", "performance", {c: r(c) for c in _small} | {c: sig(c) for c in ("equity", "peak_equity")} | {"turnover": r("turnover", 4), "num_trades": "num_trades", "num_holdings": "num_holdings"})
        + " UNION ALL " + _figures("recent", "rolling", {c: r(c) for c in _rolling} | {"num_days": "num_days"})
        + "".join(f" UNION ALL SELECT strategy_id, DATE '{FILL}', 'holdings', kdcode::VARCHAR, '{c}', {c}::DOUBLE, entry_date::VARCHAR FROM target" for c in ("weight", "rank", "score"))
        + f" UNION ALL SELECT strategy_id, DATE '{FILL}', 'orders', kdcode::VARCHAR, side, NULL, reason FROM orders_t",
    ),
)
def tk(spark, sf):
    ledger = stable(le.performance_ledger(ledger_input(spark, sf), digits=None))
    d = Decision(spark, sf)
    shown = rounded(rounded(significant(ledger, "equity", "peak_equity"), *_small), "turnover", digits=4)
    target = rounded(rounded(d.target(), "weight"), "score", digits=5)
    return le.report_rows(shown, rounded(pf.recent_stats(ledger), *_rolling), target, d.orders(), FILL)
