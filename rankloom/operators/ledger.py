"""Paper-trade tables: targets, orders, fills, positions and the performance ledger (T-a to T-k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity
from rankloom.functions.groups import calendar, keep_last, lookup
from rankloom.schema import safe_div


def target_portfolio(decision: DataFrame, ranked: DataFrame, strategies: DataFrame, holdings: DataFrame, dt: str) -> DataFrame:
    """T-a. Equal-weight targets with rank and score; the entry date of a kept name is carried over."""
    target = decision.where("status IN ('survivor', 'entry')").select("strategy_id", "kdcode")
    n = target.groupBy("strategy_id").agg(F.count("*").alias("n"))
    today = F.lit(dt).cast("date")
    names = target.join(n, "strategy_id").join(strategies.select("strategy_id", "model_id"), "strategy_id")
    return (
        lookup(names, ranked.select("model_id", "kdcode", "rank", "score"), ["model_id", "kdcode"])
        .join(holdings.select("strategy_id", "kdcode", "entry_date"), ["strategy_id", "kdcode"], "left")
        .select(
            "strategy_id", "kdcode", today.alias("dt"), F.round(1.0 / F.col("n"), 6).alias("weight"), "rank",
            F.round(F.coalesce("score", F.lit(0.0)), 5).alias("score"), F.coalesce("entry_date", today).alias("entry_date"),
        )
    )


def orders(decision: DataFrame, holdings: DataFrame, dt: str) -> DataFrame:
    """T-b. SELL and BUY orders with their reason; a strategy without holdings fills for the first time."""
    had = holdings.select("strategy_id").distinct().withColumn("_had", F.lit(True))
    d = decision.where("status <> 'survivor'").join(had, "strategy_id", "left")
    drop = F.format_string(
        "rank_drop %d->%d (%s)", "prev_rank", "curr_rank",
        F.concat(F.when(F.col("rank_drop") >= 0, "+").otherwise(""), F.col("rank_drop").cast("string")),
    )
    reason = (
        F.when(F.col("status") == "exit", drop)
        .when(F.col("status") == "dropped", "dropped_from_universe")
        .when(F.col("_had"), "new_entry")
        .otherwise("initial_fill")
    )
    side = F.when(F.col("status") == "entry", "BUY").otherwise("SELL")
    return d.select("strategy_id", "kdcode", F.lit(dt).cast("date").alias("dt"), side.alias("side"), reason.alias("reason"))


def fills(order_rows: DataFrame, bars: DataFrame, fill_date: str) -> DataFrame:
    """T-c. Orders filled at the open of the fill date."""
    day = F.lit(fill_date).cast("date")
    prices = bars.where(F.col("dt") == day).select("kdcode", F.round("open", 4).alias("fill_price"))
    return lookup(order_rows.drop("dt"), prices, ["kdcode"]).select(
        "strategy_id", "kdcode", day.alias("dt"), "side", "fill_price", "reason"
    )


def position_returns(positions: DataFrame, bars: DataFrame, return_date: str, prev_date: str) -> DataFrame:
    """T-d. Open-to-open return and contribution of each active position; missing or zero opens drop out."""
    at = bars.where(F.col("dt").isin(F.lit(return_date).cast("date"), F.lit(prev_date).cast("date")))

    def open_on(d: str) -> Column:
        return F.max(F.when(F.col("dt") == F.lit(d).cast("date"), F.col("open")))

    opens = at.groupBy("kdcode").agg(open_on(prev_date).alias("open_prev"), open_on(return_date).alias("open_curr"))
    out = positions.join(opens, "kdcode").where("open_prev <> 0 AND open_curr IS NOT NULL")
    ret = F.col("open_curr") / F.col("open_prev") - 1
    return out.select(
        "strategy_id", "kdcode", F.lit(return_date).cast("date").alias("dt"), "weight", "entry_date",
        F.round("open_prev", 4).alias("open_prev"), F.round("open_curr", 4).alias("open_curr"),
        ret.alias("stock_return"), (ret * F.col("weight")).alias("contribution"),
    )


def portfolio_return(rows: DataFrame) -> DataFrame:
    """T-d. Mean return of a strategy's positions."""
    return rows.groupBy("strategy_id", "dt").agg(F.avg("stock_return").alias("portfolio_return"), F.count("*").alias("num_stocks"))


def benchmark_return(bars: DataFrame, ticker: str) -> DataFrame:
    """T-e. Open-to-open return of one ticker up to each of its dates."""
    one = bars.where(F.col("kdcode") == ticker)
    return one.select("dt", (safe_div(F.col("open"), F.lag("open").over(by_entity())) - 1).alias("benchmark_return"))


# What a month carries on: sums of net and benchmark returns, growth, and its extremes since the month began.
LOCAL = ("net_sum", "benchmark_sum", "growth", "peak", "trough")


def month_ledger(daily: DataFrame, spread_bps: float = 5.0, slippage_bps: float = 5.0) -> DataFrame:
    """Each day with the figures of ``LOCAL`` from the first day of its month on; one row per strategy and date."""
    w = Window.partitionBy("strategy_id", F.trunc("dt", "month")).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("portfolio_return") - day_cost(spread_bps, slippage_bps)
    growth = daily.withColumn("growth", F.product(1 + net).over(w))
    return growth.withColumns(
        {"net_sum": F.sum(net).over(w), "benchmark_sum": F.sum(F.coalesce("benchmark_return", F.lit(0.0))).over(w), 
         "peak": F.max("growth").over(w), "trough": F.min("growth").over(w)}
    )


def month_summaries(rows: DataFrame) -> DataFrame:
    """The last day of each strategy and month of ``month_ledger``: what the month carries on."""
    last = F.max_by(F.struct(*LOCAL), "dt").alias("last")
    ends = rows.groupBy("strategy_id", F.trunc("dt", "month").alias("month")).agg(F.max("dt").alias("dt"), F.count("*").alias("days"), last)
    return ends.select("strategy_id", "dt", "days", *[f"last.{c}" for c in LOCAL])


def compose_ledger(rows: DataFrame, months: DataFrame, digits: int | None = 6, spread_bps: float = 5.0, slippage_bps: float = 5.0) -> DataFrame:
    """The ledger from rows of ``month_ledger`` and the summaries of all months: sums add up, growth multiplies, and the
    peak before a month is the largest of the earlier months' peaks, each times the growth before it (of their troughs,
    where that growth is negative)."""
    before = Window.partitionBy("strategy_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)

    def joined(carried: Column, local: Column, both: Column) -> Column:
        return F.coalesce(both, local, carried)

    def highest(growth: str) -> Column:
        grown = F.coalesce(growth, F.lit(1.0))
        return F.greatest(grown * F.col("peak"), grown * F.col("trough"))

    carried = months.withColumns({"net_before": F.sum("net_sum").over(before), "bm_before": F.sum("benchmark_sum").over(before), "growth_before": F.product("growth").over(before)})
    carried = carried.withColumn("peak_before", F.max(highest("growth_before")).over(before))
    carried = carried.select("strategy_id", F.trunc("dt", "month").alias("month"), "net_before", "bm_before", "growth_before", "peak_before")
    d = rows.withColumn("month", F.trunc("dt", "month")).join(carried, ["strategy_id", "month"])
    d = d.withColumns({
        "est_cost": day_cost(spread_bps, slippage_bps), "net_return": F.col("portfolio_return") - day_cost(spread_bps, slippage_bps),
        "excess_return": F.col("portfolio_return") - F.coalesce("benchmark_return", F.lit(0.0)),
        "cum_return": joined(F.col("net_before"), F.col("net_sum"), F.col("net_before") + F.col("net_sum")),
        "cum_benchmark": joined(F.col("bm_before"), F.col("benchmark_sum"), F.col("bm_before") + F.col("benchmark_sum")),
        "equity": joined(F.col("growth_before"), F.col("growth"), F.col("growth_before") * F.col("growth")),
        "peak_equity": F.greatest(F.lit(1.0), F.col("peak_before"), highest("growth_before")),
    })
    return shown_ledger(d, digits)


def day_cost(spread_bps: float, slippage_bps: float) -> Column:
    return F.col("turnover") * ((spread_bps + slippage_bps) / 10000) * 2


def performance_ledger(daily: DataFrame, spread_bps: float = 5.0, slippage_bps: float = 5.0, order: str = "seq", digits: int | None = 6) -> DataFrame:
    """T-f. Cumulative ledger per strategy; the last row of a date replaces earlier ones.

    ``daily`` has strategy_id, dt, portfolio_return, benchmark_return, turnover, num_trades,
    num_holdings and an ingest order. Recomputed by windows over one row per strategy and date.
    """
    d = keep_last(daily, ["strategy_id", "dt"], order)
    bm = F.coalesce("benchmark_return", F.lit(0.0))
    w = Window.partitionBy("strategy_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("est_cost", day_cost(spread_bps, slippage_bps)).withColumn("net_return", F.col("portfolio_return") - F.col("est_cost"))
    d = d.withColumn("excess_return", F.col("portfolio_return") - bm)
    d = d.withColumn("cum_return", F.sum("net_return").over(w)).withColumn("cum_benchmark", F.sum(bm).over(w))
    d = d.withColumn("equity", F.product(1 + F.col("net_return")).over(w))
    return shown_ledger(d.withColumn("peak_equity", F.greatest(F.lit(1.0), F.max("equity").over(w))), digits)


def shown_ledger(d: DataFrame, digits: int | None) -> DataFrame:
    """The columns of the ledger, with the drawdown, rounded."""
    d = d.withColumn("drawdown", F.when(F.col("peak_equity") > 0, F.col("equity") / F.col("peak_equity") - 1).otherwise(0.0))

    def shown(c: str, n: int = 6) -> Column:
        return (F.col(c) if digits is None else F.round(c, min(n, digits))).alias(c)

    return d.select(
        "strategy_id", "dt", shown("portfolio_return"), shown("net_return"), shown("benchmark_return"), shown("excess_return"),
        shown("cum_return"), shown("cum_benchmark"), shown("equity"), shown("peak_equity"), shown("drawdown"),
        shown("turnover", 4), shown("est_cost"), "num_trades", "num_holdings",
    )


def upsert_trades(log: DataFrame, new: DataFrame) -> DataFrame:
    """T-g. Trade log with new rows replacing old ones of the same (strategy, name, date, side)."""
    both = log.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    return keep_last(both, ["strategy_id", "kdcode", "dt", "side"], "_b").drop("_b")


def active_positions(target: DataFrame, fill_rows: DataFrame) -> DataFrame:
    """T-h. Current holdings with the price of their BUY fill, if any."""
    buys = fill_rows.where("side = 'BUY'").select("strategy_id", "kdcode", "fill_price")
    return target.join(buys, ["strategy_id", "kdcode"], "left").select("strategy_id", "kdcode", "weight", "entry_date", "fill_price")


def pending_dates(bars: DataFrame, processed: DataFrame) -> DataFrame:
    """T-i. Trading dates after the last processed one (all when there is none)."""
    last = processed.agg(F.max("dt").alias("m")).scalar()
    return calendar(bars).where(last.isNull() | (F.col("dt") > last))


def compare_runs(metrics: DataFrame, key: str, a, b, names: list[str]) -> DataFrame:
    """T-j. (metric, value_a, value_b, delta) of two runs."""
    long = metrics.where(F.col(key).isin(a, b)).select(key, *[F.col(n).cast("double") for n in names]).unpivot([key], names, "metric", "v")
    side = long.groupBy("metric").agg(
        F.max(F.when(F.col(key) == a, F.col("v"))).alias("value_a"), F.max(F.when(F.col(key) == b, F.col("v"))).alias("value_b")
    )
    return side.withColumn("delta", F.col("value_a") - F.col("value_b"))


def report_rows(ledger: DataFrame, recent: DataFrame, target: DataFrame, order_rows: DataFrame, dt: str) -> DataFrame:
    """T-k. The daily report as typed rows (strategy_id, dt, section, kdcode, item, value, note).

    Sections: performance of the date and rolling statistics, a row for each figure; holdings, with weight, rank and score
    of each name and its entry date as note; orders, with the side as item and the reason as note.
    """
    day = F.lit(dt).cast("date")

    def figures(df: DataFrame, section: str, code: Column, columns: list[str], note: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns])
        rows = df.select("strategy_id", code.alias("kdcode"), note.alias("note"), F.explode(cells).alias("c"))
        return rows.select("strategy_id", day.alias("dt"), F.lit(section).alias("section"), "kdcode", "c.item", "c.value", "note")

    none, code = F.lit(None).cast("string"), F.col("kdcode").cast("string")
    numbers = lambda df: [c for c in df.columns if c not in ("strategy_id", "dt")]
    side = order_rows.select("strategy_id", day.alias("dt"), F.lit("orders").alias("section"), code.alias("kdcode"), F.col("side").alias("item"), F.lit(None).cast("double").alias("value"), F.col("reason").alias("note"))
    return (
        figures(ledger.where(F.col("dt") == day), "performance", none, numbers(ledger), none)
        .unionByName(figures(recent, "rolling", none, numbers(recent), none))
        .unionByName(figures(target, "holdings", code, ["weight", "rank", "score"], F.col("entry_date").cast("string")))
        .unionByName(side)
    )


def daily_report(ledger: DataFrame, recent: DataFrame, target: DataFrame, order_rows: DataFrame, dt: str) -> DataFrame:
    """T-k. One JSON document per strategy: performance of the date, rolling stats, holdings, orders.

    Lists hold the K names of a strategy and the orders of one date.
    """
    day = F.lit(dt).cast("date")
    perf = ledger.where(F.col("dt") == day).select("strategy_id", F.struct(*[c for c in ledger.columns if c != "strategy_id"]).alias("performance"))
    roll = recent.select("strategy_id", F.struct(*[c for c in recent.columns if c != "strategy_id"]).alias("rolling"))

    def listed(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in ("kdcode", *[x for x in df.columns if x not in ("strategy_id", "kdcode")])])
        return df.groupBy("strategy_id").agg(F.sort_array(F.collect_list(row)).alias(name))

    out = perf.join(roll, "strategy_id", "left").join(listed(target, "holdings"), "strategy_id", "left").join(listed(order_rows, "orders"), "strategy_id", "left")
    return out.select("strategy_id", day.alias("dt"), F.to_json(F.struct("performance", "rolling", "holdings", "orders")).alias("report"))
