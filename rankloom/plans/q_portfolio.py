"""Back-tests of the strategy table on the monthly panel, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import evaluate as ev
from rankloom.operators import portfolio as po
from rankloom.plans import testdata as td
from rankloom.plans.registry import SHARED, check_sql, query, r, rounded, share
from rankloom.session import stable

CUR, PREV = "2000-06-01", "2000-05-01"

share("o2o", "SELECT kdcode, dt, lead(open) OVER (PARTITION BY kdcode ORDER BY dt) / open - 1 AS stock_return FROM bars_m", "bars_m")
share("bm", "SELECT dt, avg(stock_return) AS benchmark_return FROM o2o GROUP BY dt", "o2o")
share(
    "entry",
    "SELECT * FROM (SELECT dt AS pred_date, lead(dt) OVER (ORDER BY dt) AS entry_date FROM (SELECT DISTINCT dt FROM bars_m)) WHERE entry_date IS NOT NULL",
    "bars_m",
)
share("plain", "SELECT * FROM strategies WHERE min_rank_drop = 0", "strategies")
share(
    "days",
    """SELECT s.*, d.pred_date, d.n_preds, d.day_no, e.entry_date FROM (SELECT model_id, dt AS pred_date, count(*) AS n_preds,
    row_number() OVER (PARTITION BY model_id ORDER BY dt) - 1 AS day_no FROM scores GROUP BY 1, 2) d JOIN plain s ON s.model_id = d.model_id LEFT JOIN entry e ON e.pred_date = d.pred_date""",
    "scores plain entry",
)
share(
    "rebal",
    """SELECT *, row_number() OVER w AS seq, CASE WHEN style = 'daily' THEN day_no + 1 ELSE lead(day_no, 1, 1000000) OVER w END AS until_no FROM
    (SELECT *, CASE WHEN style = 'staggered' THEN day_no % holding ELSE 0 END AS tranche_id FROM days WHERE n_preds >= top_k AND (style <> 'block' OR day_no % holding = 0))
    WINDOW w AS (PARTITION BY strategy_id, tranche_id ORDER BY day_no)""",
    "days",
)
share(
    "targets",
    "SELECT b.strategy_id, b.tranche_id, b.seq, k.kdcode FROM rebal b JOIN ranked k ON k.model_id = b.model_id AND k.dt = b.pred_date AND k.rank <= b.top_k",
    "rebal ranked",
)
share(
    "held",
    """SELECT b.strategy_id, b.tranche_id, b.seq, b.day_no AS rebalance_no, d.day_no, d.pred_date, d.entry_date, d.n_preds, d.top_k, d.style, d.holding, d.spread, d.slippage, d.model_id
    FROM rebal b JOIN days d ON d.strategy_id = b.strategy_id AND d.day_no >= b.day_no AND d.day_no < b.until_no
    WHERE d.entry_date IS NOT NULL AND (d.style = 'block' OR d.n_preds >= d.top_k)""",
    "rebal days",
)
share(
    "positions",
    "SELECT h.*, t.kdcode, o.stock_return FROM held h JOIN targets t USING (strategy_id, tranche_id, seq) LEFT JOIN o2o o ON o.kdcode = t.kdcode AND o.dt = h.entry_date",
    "held targets o2o",
)
share(
    "tranche_days",
    """SELECT strategy_id, tranche_id, seq, rebalance_no, day_no, any_value(pred_date) AS pred_date, any_value(entry_date) AS entry_date, any_value(style) AS style,
    any_value(holding) AS holding, any_value(spread) AS spread, any_value(slippage) AS slippage, any_value(top_k) AS top_k,
    avg(stock_return) AS tranche_return, count(stock_return) AS n_realised, count(*) AS n_held FROM positions GROUP BY 1, 2, 3, 4, 5 HAVING count(stock_return) > 0""",
    "positions",
)
share(
    "sets",
    """SELECT b.strategy_id, b.tranche_id, b.seq, b.top_k, b.pred_date, b.entry_date, b.model_id, row_number() OVER (PARTITION BY b.strategy_id, b.tranche_id ORDER BY b.seq) AS set_no
    FROM rebal b WHERE b.style <> 'daily' OR EXISTS (SELECT 1 FROM tranche_days t WHERE t.strategy_id = b.strategy_id AND t.tranche_id = b.tranche_id AND t.seq = b.seq)""",
    "rebal tranche_days",
)
share("names", "SELECT s.strategy_id, s.tranche_id, s.set_no, t.kdcode FROM sets s JOIN targets t USING (strategy_id, tranche_id, seq)", "sets targets")
share(
    "buys",
    "SELECT c.* FROM names c ANTI JOIN names p ON p.strategy_id = c.strategy_id AND p.tranche_id = c.tranche_id AND p.kdcode = c.kdcode AND p.set_no = c.set_no - 1",
    "names",
)
share(
    "sells",
    """SELECT p.strategy_id, p.tranche_id, p.set_no + 1 AS set_no, p.kdcode FROM names p ANTI JOIN names c
    ON p.strategy_id = c.strategy_id AND p.tranche_id = c.tranche_id AND p.kdcode = c.kdcode AND c.set_no = p.set_no + 1""",
    "names",
)
share(
    "turn",
    """SELECT s.strategy_id, s.tranche_id, s.set_no, s.seq, s.top_k, coalesce(v.n, 0) AS num_sold, coalesce(b.n, 0) AS num_bought FROM sets s
    LEFT JOIN (SELECT strategy_id, tranche_id, set_no, count(*) AS n FROM buys GROUP BY 1, 2, 3) b USING (strategy_id, tranche_id, set_no)
    LEFT JOIN (SELECT strategy_id, tranche_id, set_no, count(*) AS n FROM sells GROUP BY 1, 2, 3) v USING (strategy_id, tranche_id, set_no)""",
    "sets buys sells",
)
share(
    "bt_daily",
    """WITH g AS (SELECT strategy_id, day_no, pred_date, entry_date, style, holding, spread, slippage, avg(tranche_return) AS gross_return, count(*) AS n_tranches, sum(n_held)::BIGINT AS n_held
      FROM tranche_days GROUP BY ALL),
    c AS (SELECT h.strategy_id, h.day_no, t.num_sold + t.num_bought AS num_trades, (t.num_sold + t.num_bought) / (2.0 * t.top_k) AS one_way
      FROM held h JOIN turn t USING (strategy_id, tranche_id, seq) WHERE h.day_no = h.rebalance_no),
    j AS (SELECT g.*, coalesce(c.num_trades, 0) AS num_trades, (coalesce(c.one_way, 0) / CASE WHEN style = 'staggered' THEN holding ELSE 1 END)::DOUBLE AS turnover, bm.benchmark_return
      FROM g LEFT JOIN c ON c.strategy_id = g.strategy_id AND c.day_no = g.day_no LEFT JOIN bm ON bm.dt = g.entry_date)
    SELECT strategy_id, style, pred_date, entry_date, n_tranches, n_held, gross_return, turnover, num_trades, turnover * (spread + 2 * slippage) AS cost,
      gross_return - turnover * (spread + 2 * slippage) AS net_return, coalesce(benchmark_return, 0) AS benchmark_return FROM j""",
    "tranche_days held turn bm",
)

DAILY_COLS = ("gross_return", "turnover", "cost", "net_return", "benchmark_return")


def daily_sql(style: str) -> str:
    return check_sql(
        "bt_daily",
        "SELECT strategy_id, pred_date, entry_date, n_tranches, n_held, num_trades, " + ", ".join(f"{r(c)} AS {c}" for c in DAILY_COLS)
        + f" FROM bt_daily WHERE style LIKE '{style}'",
    )


def plain(spark, style: str = "%"):
    return td.strategies(spark).where(F.col("style").like(style) & (F.col("min_rank_drop") == 0))


def run(spark, sf, style: str = "%", ranked=None) -> po.Backtest:
    bars = stable(td.bars_m(spark, sf))
    return po.backtest(td.scores(spark, sf, bars), bars, plain(spark, style), ranked)


def ranked_run(spark, sf, style: str = "%"):
    bars = stable(td.bars_m(spark, sf))
    ranked = stable(po.rank_scores(td.scores(spark, sf, bars)))
    return po.backtest(ranked, bars, plain(spark, style), ranked), ranked


@query(
    "b1_return_columns",
    check_sql(
        "bars_m",
        f"""SELECT kdcode, dt, {r('lead(close, 3) OVER w / lead(close) OVER w - 1')} AS forward_return_3d, {r('lead(close) OVER w / close - 1')} AS next_day_return,
    {r('(close - open) / open')} AS tradeable_return, {r('coalesce((open - lag(close) OVER w) / lag(close) OVER w, 0)')} AS overnight_gap,
    {r('(close - lag(close) OVER w) / lag(close) OVER w')} AS total_return_check, {r('lead(open) OVER w / open - 1')} AS open_to_open_return,
    {r('coalesce(close / lag(close) OVER w - 1, 0)')} AS daily_return FROM bars_m WINDOW w AS (PARTITION BY kdcode ORDER BY dt)""",
    ),
)
def b1(spark, sf):
    cols = (
        "forward_return_3d", "next_day_return", "tradeable_return", "overnight_gap", "total_return_check",
        "open_to_open_return", "daily_return",
    )
    return rounded(po.return_columns(td.bars_m(spark, sf), 3).select("kdcode", "dt", *cols), *cols)


@query("b2_benchmark", check_sql("bm", f"SELECT dt, {r('benchmark_return')} AS benchmark_return FROM bm"))
def b2(spark, sf):
    return rounded(po.benchmark(po.open_to_open(td.bars_m(spark, sf))), "benchmark_return")


@query("b3_entry_dates", check_sql("entry", "SELECT * FROM entry"))
def b3(spark, sf):
    return po.entry_dates(td.bars_m(spark, sf))


@query("b4_daily_strategy", daily_sql("daily"))
def b4(spark, sf):
    return rounded(run(spark, sf, "daily").daily, *DAILY_COLS)


@query(
    "b5_turnover",
    check_sql(
        "turn",
        f"""SELECT strategy_id, tranche_id, set_no, num_sold, num_bought, top_k - num_bought AS num_held, num_sold + num_bought AS num_trades, greatest(num_sold, num_bought) AS num_changes,
    {r('(num_sold + num_bought) / (2.0 * top_k)')} AS one_way_turnover, {r('(num_sold + num_bought) / top_k')} AS two_way_turnover FROM turn""",
    ),
)
def b5(spark, sf):
    bt = run(spark, sf)
    sets = po.numbered_sets(bt.targets, bt.rebal, po.tranche_days(bt.pos))
    df = po.turnover(sets, ("strategy_id", "tranche_id"), "set_no", "top_k")
    return rounded(df, "one_way_turnover", "two_way_turnover")


@query(
    "b6_transaction_cost",
    check_sql(
        "turn plain",
        f"""WITH t AS (SELECT strategy_id, tranche_id, set_no, (num_sold + num_bought) / (2.0 * top_k) AS o FROM turn)
    SELECT t.strategy_id, tranche_id, set_no, {r('o * (spread / 2 + slippage)', 8)} AS sell_cost, {r('o * (spread / 2 + slippage)', 8)} AS buy_cost, {r('o * (spread + 2 * slippage)', 8)} AS total_cost,
    {r('o * spread', 8)} AS spread_component, {r('2 * o * slippage', 8)} AS slippage_component FROM t JOIN plain p ON p.strategy_id = t.strategy_id""",
    ),
)
def b6(spark, sf):
    bt = run(spark, sf)
    sets = po.numbered_sets(bt.targets, bt.rebal, po.tranche_days(bt.pos))
    t = po.turnover(sets, ("strategy_id", "tranche_id"), "set_no", "top_k")
    costs = ("sell_cost", "buy_cost", "total_cost", "spread_component", "slippage_component")
    df = po.transaction_cost(t.join(plain(spark).select("strategy_id", "spread", "slippage"), "strategy_id"))
    return rounded(df.select("strategy_id", "tranche_id", "set_no", *costs), *costs, digits=8)


@query("b7_staggered_strategy", daily_sql("staggered"))
def b7(spark, sf):
    return rounded(run(spark, sf, "staggered").daily, *DAILY_COLS)


@query("b8_block_strategy", daily_sql("block"))
def b8(spark, sf):
    return rounded(run(spark, sf, "block").daily, *DAILY_COLS)


def gate_inputs(spark, sf):
    """Ranks of two dates, the earlier top-K as holdings, and the gated strategies."""
    s = td.scores(spark, sf).where(F.col("dt").isin(F.lit(CUR).cast("date"), F.lit(PREV).cast("date")))
    ranked = stable(po.rank_scores(s))
    cur = ranked.where(F.col("dt") == F.lit(CUR).cast("date"))
    prev = ranked.where(F.col("dt") == F.lit(PREV).cast("date")).withColumnRenamed("rank", "prev_rank")
    gated = td.strategies(spark).where("min_rank_drop > 0")
    holdings = prev.join(gated, "model_id").where(F.col("prev_rank") <= F.col("top_k")).select(
        "strategy_id", "kdcode", F.lit(PREV).cast("date").alias("entry_date")
    )
    return cur, holdings, prev, gated


share("gated", "SELECT * FROM strategies WHERE min_rank_drop > 0", "strategies")
share("cur_ranks", f"SELECT * FROM ranked WHERE dt = DATE '{CUR}'", "ranked")
share("prev_ranks", f"SELECT * FROM ranked WHERE dt = DATE '{PREV}'", "ranked")
share(
    "gate",
    """WITH h AS (SELECT g.strategy_id, g.model_id, g.top_k, g.min_rank_drop, p.kdcode, p.rank AS prev_rank FROM gated g JOIN prev_ranks p ON p.model_id = g.model_id AND p.rank <= g.top_k),
    d AS (SELECT h.*, c.rank AS curr_rank, CASE WHEN c.rank IS NULL THEN 'dropped' WHEN c.rank - h.prev_rank >= h.min_rank_drop THEN 'exit' ELSE 'survivor' END AS status
      FROM h LEFT JOIN cur_ranks c ON c.model_id = h.model_id AND c.kdcode = h.kdcode),
    e AS (SELECT g.strategy_id, c.kdcode, c.rank, g.top_k, row_number() OVER (PARTITION BY g.strategy_id ORDER BY c.rank) AS slot, (SELECT count(*) FROM d WHERE d.strategy_id = g.strategy_id AND status = 'survivor') AS n
      FROM gated g JOIN cur_ranks c ON c.model_id = g.model_id ANTI JOIN (SELECT * FROM d WHERE status = 'survivor') s ON s.strategy_id = g.strategy_id AND s.kdcode = c.kdcode)
    SELECT strategy_id, kdcode, status, prev_rank, curr_rank, curr_rank - prev_rank AS rank_drop FROM d
    UNION ALL SELECT strategy_id, kdcode, 'entry', NULL, rank, NULL FROM e WHERE slot <= top_k - n""",
    "gated cur_ranks prev_ranks",
)


@query("b9_rank_drop_step", check_sql("gate", "SELECT * FROM gate"))
def b9(spark, sf):
    return po.rank_drop_step(*gate_inputs(spark, sf))


def gate_fold_sql(days: str) -> str:
    """Recursive CTEs after ``days`` (key, seq, day_no, top_k, daily, names (k, rank, fell, real) by rank): ``fold`` has the
    names held before (was), staying and aimed at (target) by key and seq."""
    return f"""fold AS (SELECT key, 0::BIGINT AS seq, NULL::BIGINT AS day_no, []::BIGINT[] AS held, []::BIGINT[] AS was, []::BIGINT[] AS stay, []::BIGINT[] AS target FROM (SELECT DISTINCT key FROM {days})
    UNION ALL
    SELECT key, seq, day_no, CASE WHEN NOT daily OR len(list_filter(names, lambda n: n.real AND list_contains(target, n.k))) > 0 THEN target ELSE held END, was, stay, target FROM
    (SELECT *, list_concat(stay, list_slice(list_filter(list_transform(names, lambda n: n.k), lambda c: NOT list_contains(stay, c)), 1, top_k - len(stay))) AS target FROM
    (SELECT *, list_transform(list_filter(names, lambda n: list_contains(was, n.k) AND NOT n.fell), lambda n: n.k) AS stay FROM
    (SELECT d.*, f.held, CASE WHEN d.daily AND d.day_no - f.day_no > 1 THEN []::BIGINT[] ELSE f.held END AS was FROM fold f JOIN {days} d ON d.key = f.key AND d.seq = f.seq + 1))))"""


def gated_check_sql(needs: str, body: str) -> str:
    """``check_sql`` with the gated strategies in place of the plain ones and the gate's targets."""
    gate = """gate_days AS (SELECT {'s': b.strategy_id, 't': b.tranche_id} AS key, b.seq, any_value(b.day_no) AS day_no, any_value(b.top_k) AS top_k, any_value(b.style) = 'daily' AS daily,
      list({'k': k.kdcode, 'rank': k.rank, 'fell': coalesce(k.rank - p.rank >= b.min_rank_drop, false), 'real': o.stock_return IS NOT NULL} ORDER BY k.rank) AS names
    FROM rebal b JOIN ranked k ON k.model_id = b.model_id AND k.dt = b.pred_date
    LEFT JOIN rebal pb ON pb.strategy_id = b.strategy_id AND pb.tranche_id = b.tranche_id AND pb.seq = b.seq - 1
    LEFT JOIN ranked p ON p.model_id = b.model_id AND p.dt = pb.pred_date AND p.kdcode = k.kdcode
    LEFT JOIN o2o o ON o.kdcode = k.kdcode AND o.dt = b.entry_date GROUP BY 1, 2),
    """ + gate_fold_sql("gate_days")
    aimed = "SELECT key.s AS strategy_id, key.t AS tranche_id, seq, unnest(target) AS kdcode FROM fold WHERE seq > 0"
    sql = check_sql("o2o rebal ranked " + needs, body)
    for old, new in ((f"plain AS ({SHARED['plain'][1]})", f"plain AS ({SHARED['gated'][1]})"), (f"targets AS ({SHARED['targets'][1]})", f"{gate},\ntargets AS ({aimed})")):
        if old not in sql:
            raise ValueError(f"no {old[:20]} in the check SQL")
        sql = sql.replace(old, new)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "b10_gated_strategies",
    gated_check_sql("bt_daily", "SELECT strategy_id, pred_date, entry_date, n_tranches, n_held, num_trades, " + ", ".join(f"{r(c)} AS {c}" for c in DAILY_COLS) + " FROM bt_daily"),
)
def b10(spark, sf):
    bars = stable(td.bars_m(spark, sf))
    ranked = stable(po.rank_scores(td.scores(spark, sf, bars)))
    gated = td.strategies(spark).where("min_rank_drop > 0")
    return rounded(po.gated_backtest(ranked, bars, gated).daily, *DAILY_COLS)


share(
    "holdings",
    """WITH a AS (SELECT strategy_id, day_no, count(*) AS n_tranches FROM tranche_days GROUP BY 1, 2)
    SELECT p.strategy_id, p.tranche_id, p.pred_date, p.entry_date, p.kdcode, CASE WHEN p.n_preds >= p.top_k THEN k.rank END AS rank, k.score,
      1.0::DOUBLE / (a.n_tranches * CASE WHEN p.style = 'block' THEN t.n_held ELSE t.n_realised END) AS weight, p.stock_return,
      p.stock_return / (a.n_tranches * CASE WHEN p.style = 'block' THEN t.n_held ELSE t.n_realised END) AS contribution
    FROM positions p JOIN tranche_days t ON t.strategy_id = p.strategy_id AND t.tranche_id = p.tranche_id AND t.day_no = p.day_no
    JOIN a ON a.strategy_id = p.strategy_id AND a.day_no = p.day_no LEFT JOIN ranked k ON k.model_id = p.model_id AND k.dt = p.pred_date AND k.kdcode = p.kdcode
    WHERE p.stock_return IS NOT NULL""",
    "positions tranche_days ranked",
)
HOLD = ("score", "weight", "stock_return", "contribution")


@query(
    "b11_holdings_records",
    check_sql("holdings", "SELECT strategy_id, tranche_id, pred_date, entry_date, kdcode, rank, " + ", ".join(f"{r(c)} AS {c}" for c in HOLD) + " FROM holdings"),
)
def b11(spark, sf):
    return rounded(po.holdings_records(*ranked_run(spark, sf)), *HOLD)


share(
    "journal",
    """WITH e AS (SELECT *, 'BUY' AS action FROM buys UNION ALL SELECT *, 'SELL' FROM sells)
    SELECT e.strategy_id, e.tranche_id, coalesce(s.entry_date, s.pred_date) AS date, s.pred_date, e.kdcode, e.action, k.rank, k.score
    FROM e JOIN sets s USING (strategy_id, tranche_id, set_no) LEFT JOIN ranked k ON k.model_id = s.model_id AND k.dt = s.pred_date AND k.kdcode = e.kdcode""",
    "buys sells sets ranked",
)


@query("b12_trade_journal", check_sql("journal", f"SELECT strategy_id, tranche_id, date, pred_date, kdcode, action, rank, {r('score')} AS score FROM journal"))
def b12(spark, sf):
    return rounded(po.trade_journal(*ranked_run(spark, sf)), "score")


@query(
    "b13_prediction_pairs",
    check_sql(
        "scores",
        f"""SELECT s.model_id, s.dt, s.kdcode, {r('s.score')} AS score, {r('f.a')} AS actual FROM scores s JOIN
    (SELECT kdcode, dt, lead(close, 3) OVER w / lead(close) OVER w - 1 AS a FROM bars_m WINDOW w AS (PARTITION BY kdcode ORDER BY dt)) f
    ON f.kdcode = s.kdcode AND f.dt = s.dt WHERE f.a IS NOT NULL""",
    ),
)
def b13(spark, sf):
    df = po.prediction_pairs(td.scores(spark, sf), po.return_columns(td.bars_m(spark, sf), 3), "forward_return_3d")
    return rounded(df.select("model_id", "dt", "kdcode", "score", "actual"), "score", "actual")


share(
    "cal",
    """SELECT x.strategy_id, b.dt, coalesce(d.net_return, 0) AS portfolio_return, coalesce(b.benchmark_return, 0) AS benchmark_return
    FROM (SELECT strategy_id, min(entry_date) AS lo, max(entry_date) AS hi FROM bt_daily GROUP BY 1) x JOIN bm b ON b.dt BETWEEN x.lo AND x.hi
    LEFT JOIN bt_daily d ON d.strategy_id = x.strategy_id AND d.entry_date = b.dt""",
    "bt_daily bm",
)


@query(
    "b14_calendar_returns",
    check_sql("cal", f"SELECT strategy_id, dt, {r('portfolio_return')} AS portfolio_return, {r('benchmark_return')} AS benchmark_return FROM cal"),
)
def b14(spark, sf):
    bm = po.benchmark(po.open_to_open(td.bars_m(spark, sf)))
    return rounded(po.calendar_returns(run(spark, sf).daily, bm), "portfolio_return", "benchmark_return")


@query(
    "b15_parameter_sweep",
    check_sql(
        "bt_daily",
        f"""SELECT strategy_id, count(*) AS n_days, {r('avg(net_return)')} AS avg_net, {r('sum(cost)')} AS total_cost, {r('avg(turnover)')} AS avg_turnover
    FROM bt_daily GROUP BY 1""",
    ),
)
def b15(spark, sf):
    df = run(spark, sf).daily.groupBy("strategy_id").agg(
        F.count("*").alias("n_days"), F.avg("net_return").alias("avg_net"), F.sum("cost").alias("total_cost"),
        F.avg("turnover").alias("avg_turnover"),
    )
    return rounded(df, "avg_net", "total_cost", "avg_turnover")


@query("b16_top_k_backtest", check_sql("top_daily", f"SELECT model_id, dt, {r('r')} AS r FROM top_daily WHERE k = 10"))
def b16(spark, sf):
    return rounded(ev.top_k_daily(td.pairs(spark, sf), [10]).drop("k"), "r")


def flagship(spark, sf, top: int):
    """Bars, momentum, rank, the ``top`` best names, next-period entry, return against the benchmark."""
    bars = stable(td.bars_m(spark, sf))
    s = td.scores(spark, sf, bars).where("model_id = 2")
    one = po.strategies_frame(spark, [po.Strategy(1, 2, top, 1, "daily", 0.001, 0.0005, 0)])
    return rounded(po.backtest(s, bars, one).daily, *DAILY_COLS)


@query("flagship_momentum_portfolio", check_sql(
    "bt_daily",
    "SELECT 1 AS strategy_id, pred_date, entry_date, n_tranches, n_held, num_trades, " + ", ".join(f"{r(c)} AS {c}" for c in DAILY_COLS) + " FROM bt_daily WHERE strategy_id = 2",
))
def flagship_query(spark, sf):
    return flagship(spark, sf, 5)
