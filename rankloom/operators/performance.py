"""Performance statistics of return series.

Series have one row per strategy and date, so the ordered windows below are bounded by the calendar;
strategies run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.groups import attach
from rankloom.functions.normal import norm_cdf, norm_ppf
from rankloom.functions.ranking import running_total
from rankloom.schema import safe_div

YEAR = 252
BLOCK = 1 << 16  # numbers that one row of a sum stands for


def _series(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("r"))


def arr(r: Column, year: int = YEAR) -> Column:
    """P1. Annualised compound return."""
    return F.pow(F.product(1 + r), F.lit(float(year)) / F.count(r)) - 1


def avol(r: Column, ddof: int = 1, year: int = YEAR) -> Column:
    """P2. Annualised deviation."""
    return (F.stddev_samp(r) if ddof == 1 else F.stddev_pop(r)) * float(year) ** 0.5


def ratio(a: Column, b: Column) -> Column:
    """P4. ASR or CR; 0 when the divisor is 0."""
    return F.coalesce(safe_div(a, F.abs(b)), F.lit(0.0))


def drawdowns(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, order, r, cum_value, drawdown) against the running peak, which starts at the first value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = _series(df, by, order, value).withColumn("cum_value", F.product(1 + F.col("r")).over(w))
    return s.withColumn("drawdown", F.col("cum_value") / F.max("cum_value").over(w) - 1)


def return_metrics(
    df: DataFrame, by: Sequence[str] = ("strategy_id",), order: str = "dt", value: str = "portfolio_return", year: int = YEAR
) -> DataFrame:
    """P1-P4. ARR, AVoL, MDD (negative), ASR, CR, total return and number of days."""
    d = drawdowns(df, by, order, value)
    r = F.col("r")
    m = d.groupBy(*by).agg(
        arr(r, year).alias("ARR"),
        F.coalesce(avol(r, 1, year), F.lit(0.0)).alias("AVoL"),
        F.min("drawdown").alias("MDD"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.count("*").alias("num_days"),
    )
    return m.select(
        *by, "ARR", "AVoL", "MDD", ratio(F.col("ARR"), F.col("AVoL")).alias("ASR"),
        ratio(F.col("ARR"), F.col("MDD")).alias("CR"), "total_return", "num_days",
    )


def information_ratio(df: DataFrame, by: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """P5. Mean over deviation of the daily excess return, not annualised."""
    x = F.col("portfolio_return") - F.col("benchmark_return")
    return df.groupBy(*by).agg(F.coalesce(safe_div(F.avg(x), F.stddev_samp(x)), F.lit(0.0)).alias("IR"))


def summary(daily: DataFrame, calendar: DataFrame, errors: DataFrame, year: int = YEAR) -> DataFrame:
    """P6. One row per strategy: net and gross metrics, costs, calendar-aligned totals, errors."""
    net = return_metrics(daily, order="entry_date", value="net_return", year=year)
    g = F.col("gross_return")
    extra = daily.groupBy("strategy_id").agg(
        arr(g, year).alias("gross_ARR"),
        (F.product(1 + g) - 1).alias("gross_total_return"),
        F.sum("cost").alias("total_transaction_cost"),
        F.avg("turnover").alias("avg_daily_turnover"),
        (F.avg("cost") * 10000).alias("avg_daily_cost_bps"),
        F.sum("num_trades").alias("total_trades"),
        F.min("entry_date").alias("start_date"),
        F.max("entry_date").alias("end_date"),
    )
    cal = calendar.groupBy("strategy_id").agg(
        (F.product(1 + F.col("portfolio_return")) - 1).alias("total_return_calendar_aligned"),
        (F.product(1 + F.col("benchmark_return")) - 1).alias("benchmark_return"),
    )
    out = net.join(extra, "strategy_id").join(cal, "strategy_id").join(information_ratio(calendar), "strategy_id")
    out = out.join(errors, "strategy_id", "left")
    return out.withColumn("excess_return", F.col("total_return_calendar_aligned") - F.col("benchmark_return")).withColumn(
        "cost_drag_ARR", F.col("gross_ARR") - F.col("ARR")
    )


def add_significance(df: DataFrame, sharpe: str, years: str) -> DataFrame:
    """P7. ``t_stat`` and two-sided ``p_value`` by the normal approximation."""
    t = F.when(F.col(years) > 0, F.col(sharpe) * F.sqrt(years)).otherwise(0.0)
    out = df.withColumn("t_stat", t)
    return out.withColumn("p_value", 2 * (1 - norm_cdf(F.abs("t_stat"))))


def t_of_p(p: Column) -> Column:
    """P7. Inverse: 0 for p >= 1, infinite for p <= 0."""
    return F.when(p >= 1, 0.0).when(p <= 0, F.lit(float("inf"))).otherwise(norm_ppf(1 - p / 2))


def harmonic_number(df: DataFrame) -> Column:
    """1 + 1/2 + ... + 1/m for the m rows of a table, as one value that is computed once: summed over blocks of numbers,
    so that no row holds a sequence of all of them."""
    ends = df.agg(F.count("*").alias("m")).select("m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / BLOCK))).alias("b")).where("m > 0")
    numbers = ends.select(F.explode(F.sequence(F.col("b") * BLOCK + 1, F.least(F.col("m"), (F.col("b") + 1) * BLOCK))).alias("i"))
    return numbers.agg(F.sum(1.0 / F.col("i")).alias("c")).scalar()


def adjust_p_values(df: DataFrame, p: str, key: str) -> DataFrame:
    """P8. Bonferroni, Holm and BHY adjusted values; rank 1 is the smallest p.

    Ranks are counted by slices of the values, so the number of strategies may be large.
    """
    names = df.columns
    d = running_total(df.withColumn("_all", F.lit(0)), ["_all"], [p, key], F.lit(1), "p_rank", total="num_tests")
    d = d.select(*names, F.col("p_rank").cast("int").alias("p_rank"), F.col("num_tests").cast("bigint").alias("num_tests"))
    m, k, x = F.col("num_tests"), F.col("p_rank"), F.col(p)
    c_m = harmonic_number(df)
    one = F.lit(1.0)

    def capped(v: Column) -> Column:
        return F.when(m <= 1, x).otherwise(F.least(v, one))

    return d.select(
        "*",
        capped(x * m).alias("p_bonferroni"),
        capped(x * (m + 1 - k)).alias("p_holm"),
        capped(x * m * c_m / k).alias("p_bhy"),
    )


def haircut_sharpe(df: DataFrame, sharpe: str, years: str, key: str, method: str = "bhy", alpha: float = 0.05) -> DataFrame:
    """P9. Sharpe after the multiple-testing correction, with its haircut in percent."""
    if method not in ("bonferroni", "holm", "bhy"):
        raise ValueError("method must be bonferroni, holm or bhy")
    d = adjust_p_values(add_significance(df, sharpe, years), "p_value", key)
    p, s = F.col(f"p_{method}"), F.col(sharpe)
    back = F.when(F.col(years) > 0, t_of_p(p) / F.sqrt(years)).otherwise(0.0)
    size = F.greatest(F.lit(0.0), F.least(back, F.abs(s)))
    d = d.withColumn("haircut_sharpe", F.when(s < 0, -size).otherwise(size))
    pct = F.coalesce(safe_div((F.abs(s) - F.abs("haircut_sharpe")) * 100, F.abs(s)), F.lit(0.0))
    return d.select("*", pct.alias("haircut_pct"), (p < alpha).alias("is_significant"))


def cumulative_performance(daily: DataFrame) -> DataFrame:
    """P10. Portfolio and benchmark value, relative performance and drawdown per day."""
    w = Window.partitionBy("strategy_id").orderBy("entry_date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select(
        "strategy_id", "entry_date",
        F.product(1 + F.col("net_return")).over(w).alias("portfolio_value"),
        F.product(1 + F.col("benchmark_return")).over(w).alias("benchmark_value"),
    )
    return d.select(
        "*",
        (F.col("portfolio_value") / F.col("benchmark_value")).alias("relative_performance"),
        (F.col("portfolio_value") / F.max("portfolio_value").over(w) - 1).alias("portfolio_drawdown"),
    )


def period_performance(daily: DataFrame, unit: str = "MM") -> DataFrame:
    """P11. Sums, deviations and counts per calendar month (or other ``trunc`` unit)."""
    x = F.col("net_return") - F.col("benchmark_return")
    return daily.groupBy("strategy_id", F.trunc("entry_date", unit).alias("period")).agg(
        F.sum("net_return").alias("portfolio_return"),
        F.stddev_samp("net_return").alias("portfolio_volatility"),
        F.count("net_return").alias("trading_days"),
        F.sum("benchmark_return").alias("benchmark_return"),
        F.stddev_samp("benchmark_return").alias("benchmark_volatility"),
        F.sum(x).alias("excess_return"),
        F.avg(x).alias("avg_excess_return"),
    )


def attribution(holdings: DataFrame) -> DataFrame:
    """P12. Share of each holding in its day's return, in percent; NULL for a day near 0."""
    d = attach(holdings, ["strategy_id", "entry_date"], _day=F.sum("contribution"))
    pct = F.when(F.abs("_day") > 1e-12, F.col("contribution") / F.col("_day") * 100)
    return d.select(
        "strategy_id", "tranche_id", "entry_date", "pred_date", "kdcode", "stock_return", "weight", "contribution",
        pct.alias("pct_of_portfolio_return"),
    )


def composition(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """P13. NEW for names bought on the entry date, HELD otherwise."""
    buys = (
        trades.where("action = 'BUY'")
        .select("strategy_id", F.col("date").alias("entry_date"), "kdcode")
        .distinct()
        .withColumn("_new", F.lit("NEW"))
    )
    return holdings.join(buys, ["strategy_id", "entry_date", "kdcode"], "left").select(
        *holdings.columns, F.coalesce("_new", F.lit("HELD")).alias("status")
    )


def holdings_summary(holdings: DataFrame) -> DataFrame:
    """P14. Per strategy and name: times held, averages, total contribution, win rate."""
    return holdings.groupBy("strategy_id", "kdcode").agg(
        F.count("stock_return").alias("times_held"),
        F.avg("score").alias("avg_score"),
        F.avg("stock_return").alias("avg_return"),
        F.sum("contribution").alias("total_contribution"),
        F.avg((F.col("stock_return") > 0).cast("double")).alias("win_rate"),
    )


def legacy_metrics(df: DataFrame, by: Sequence[str] = ("strategy_id",), order: str = "dt", value: str = "portfolio_return") -> DataFrame:
    """P15. The older definitions: population deviation and an annualised mean/deviation ratio."""
    r = F.col("r")
    m = drawdowns(df, by, order, value).groupBy(*by).agg(
        arr(r).alias("ARR"), avol(r, 0).alias("AVol"), F.min("drawdown").alias("MDD"),
        F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"),
        (F.product(1 + r) - 1).alias("Total_Return"), F.count("*").alias("Num_Days"),
    )
    return m.select(
        *by, "ARR", "AVol", "MDD", ratio(F.col("ARR"), F.col("AVol")).alias("ASR"), ratio(F.col("ARR"), F.col("MDD")).alias("CR"),
        F.coalesce(safe_div(F.col("_m"), F.col("_s")) * YEAR**0.5, F.lit(0.0)).alias("IR"), "Total_Return", "Num_Days",
    )


def recent_stats(ledger: DataFrame, window: int = 20) -> DataFrame:
    """P16. Volatility and Sharpe proxy of the last rows; drawdown, win rate and mean of all."""
    back = Window.partitionBy("strategy_id").orderBy(F.desc("dt"))
    d = ledger.withColumn("_k", F.row_number().over(back))
    recent = F.when(F.col("_k") <= window, F.col("net_return"))
    m = d.groupBy("strategy_id").agg(
        F.coalesce(F.stddev_samp(recent), F.lit(0.0)).alias("_v"),
        F.avg(recent).alias("_m"),
        F.min("drawdown").alias("max_drawdown"),
        F.count("*").alias("num_days"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
        F.avg("net_return").alias("avg_daily_return"),
    )
    enough = F.col("num_days") >= 2
    root = YEAR**0.5
    return m.select(
        "strategy_id",
        F.when(enough, F.col("_v") * root).alias("rolling_vol_ann"),
        F.when(enough, F.coalesce(safe_div(F.col("_m"), F.col("_v")) * root, F.lit(0.0))).alias("sharpe_proxy"),
        F.when(enough, F.col("max_drawdown")).otherwise(0.0).alias("max_drawdown"),
        "num_days",
        F.when(enough, F.col("win_rate")).alias("win_rate"),
        F.when(enough, F.col("avg_daily_return")).alias("avg_daily_return"),
    )


def consistency(periods: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """P17. Spread of each metric over periods: (by, metric, mean, std, min, max, cv, range)."""
    long = periods.select(*by, *[F.col(c).cast("double") for c in metrics]).unpivot(list(by), list(metrics), "metric", "v")
    s = long.groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return s.withColumn("cv", F.coalesce(safe_div(F.col("std"), F.abs("mean")), F.lit(0.0))).withColumn(
        "range", F.col("max") - F.col("min")
    )


def is_consistent(rows: DataFrame, by: Sequence[str], limit: float = 0.5) -> DataFrame:
    """P17. True when the coefficients of variation of ARR and ASR are both below the limit."""

    def cv(m: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric") == m, F.col("cv"))), F.lit(0.0))

    out = rows.groupBy(*by).agg(cv("ARR").alias("arr_cv"), cv("ASR").alias("asr_cv"))
    return out.withColumn("is_consistent", (F.col("arr_cv") < limit) & (F.col("asr_cv") < limit))
