"""Set-based portfolio construction and back-tests for many strategies at once.

Everything is keyed by (strategy_id, tranche_id). Panel-sized inputs are only scanned, joined on
their key or reduced to the best K per date; what follows works on K names per strategy and day.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity
from rankloom.functions.groups import calendar, lookup
from rankloom.functions.ranking import in_order, row_numbers, top_k
from rankloom.schema import safe_div
from rankloom.session import stable

STYLES = ("daily", "staggered", "block")
BEST_FIRST = ("-score", "kdcode")


@dataclass(frozen=True)
class Strategy:
    """One row of the parameter table; ``min_rank_drop`` 0 turns the gate off."""

    strategy_id: int
    model_id: int
    top_k: int
    holding: int
    style: str
    spread: float
    slippage: float
    min_rank_drop: int

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"style must be one of {STYLES}")
        if self.top_k < 1 or self.holding < 1 or self.min_rank_drop < 0:
            raise ValueError("top_k and holding must be positive, min_rank_drop not negative")
        if self.style == "daily" and self.holding != 1:
            raise ValueError("a daily strategy holds for one day")


STRATEGY_SCHEMA = (
    "strategy_id int, model_id int, top_k int, holding int, style string,"
    " spread double, slippage double, min_rank_drop int"
)


def strategies_frame(spark: SparkSession, items: Iterable[Strategy]) -> DataFrame:
    rows = [{**asdict(s), "spread": float(s.spread), "slippage": float(s.slippage)} for s in items]
    return spark.createDataFrame([tuple(r.values()) for r in rows], STRATEGY_SCHEMA)


def best_first() -> list[Column]:
    """Score descending, entity ascending on ties (K2, K3)."""
    return in_order(BEST_FIRST)


def rank_scores(scores: DataFrame, by: tuple[str, ...] = ("model_id", "dt")) -> DataFrame:
    """K2. 1-based rank of every score of a date, for cross-sections of any size."""
    return row_numbers(scores, by, BEST_FIRST, "rank")


def best_scores(scores: DataFrame, k: int, by: tuple[str, ...] = ("model_id", "dt")) -> DataFrame:
    """The ``k`` best scores of a date with their rank."""
    return top_k(scores, by, best_first(), k, "rank")


# --- returns ---------------------------------------------------------------------------------


def return_columns(bars: DataFrame, label_t: int = 5) -> DataFrame:
    """B1. Forward, tradeable, gap and open-to-open returns on the entity's own rows."""
    w = by_entity()
    close, open_ = F.col("close"), F.col("open")
    prev = F.lag("close").over(w)
    nxt = F.lead("close").over(w)
    zero = F.lit(0.0)
    return bars.select(
        "*",
        (safe_div(F.lead("close", label_t).over(w), nxt) - 1).alias(f"forward_return_{label_t}d"),
        (safe_div(nxt, close) - 1).alias("next_day_return"),
        F.coalesce(safe_div(close - open_, open_), zero).alias("tradeable_return"),
        F.coalesce(safe_div(open_ - prev, prev), zero).alias("overnight_gap"),
        safe_div(close - prev, prev).alias("total_return_check"),
        (safe_div(F.lead("open").over(w), open_) - 1).alias("open_to_open_return"),
        F.coalesce(safe_div(close, prev) - 1, zero).alias("daily_return"),
    )


def open_to_open(bars: DataFrame) -> DataFrame:
    """Only the realised return the back-tests need: (kdcode, dt, stock_return)."""
    w = by_entity()
    return bars.select(
        "kdcode", "dt", (safe_div(F.lead("open").over(w), F.col("open")) - 1).alias("stock_return")
    )


def benchmark(returns: DataFrame) -> DataFrame:
    """B2. Equal-weight open-to-open return of each date."""
    return returns.groupBy("dt").agg(F.avg("stock_return").alias("benchmark_return"))


def entry_dates(bars: DataFrame) -> DataFrame:
    """B3. pred_date -> next date of the stock calendar; the last date has none and drops out.

    One row per trading date, so a single ordered pass is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    return (
        calendar(bars)
        .select(F.col("dt").alias("pred_date"), F.lead("dt").over(w).alias("entry_date"))
        .where(F.col("entry_date").isNotNull())
    )


# --- days and targets ------------------------------------------------------------------------


def prediction_days(scores: DataFrame, strategies: DataFrame, entry: DataFrame) -> DataFrame:
    """One row per strategy and prediction date: n_preds, day_no (0-based), entry_date."""
    w = Window.partitionBy("model_id").orderBy("dt")
    days = (
        scores.groupBy("model_id", "dt")
        .agg(F.count("*").alias("n_preds"))
        .withColumn("day_no", F.row_number().over(w) - 1)
        .withColumnRenamed("dt", "pred_date")
        .join(entry, "pred_date", "left")
    )
    return days.join(strategies, "model_id")


def rebalances(days: DataFrame) -> DataFrame:
    """Days on which a tranche is rebuilt, with the first later day it no longer rules.

    A day with fewer than K scores rebuilds nothing. Daily strategies book only the day itself.
    """
    d = days.where(
        (F.col("n_preds") >= F.col("top_k"))
        & ((F.col("style") != "block") | (F.col("day_no") % F.col("holding") == 0))
    ).withColumn(
        "tranche_id",
        F.when(F.col("style") == "staggered", F.col("day_no") % F.col("holding")).otherwise(0).cast("int"),
    )
    w = Window.partitionBy("strategy_id", "tranche_id").orderBy("day_no")
    return (
        d.withColumn("seq", F.row_number().over(w))
        .withColumn("prev_day_no", F.lag("day_no").over(w))
        .withColumn(
            "until_no",
            F.when(F.col("style") == "daily", F.col("day_no") + 1).otherwise(F.lead("day_no").over(w)),
        )
    )


def top_targets(rebal: DataFrame, best: DataFrame) -> DataFrame:
    """Target names of every rebalance without a gate: the K best scores."""
    b = best.select("model_id", F.col("dt").alias("pred_date"), "kdcode", "rank", "score")
    return (
        rebal.join(b, ["model_id", "pred_date"])
        .where(F.col("rank") <= F.col("top_k"))
        .select("strategy_id", "tranche_id", "seq", "kdcode")
    )


# --- booking ---------------------------------------------------------------------------------


def held_days(rebal: DataFrame, days: DataFrame) -> DataFrame:
    """(strategy, tranche, rebalance) x the days it rules, one row each."""
    last = days.groupBy("strategy_id").agg(F.max("day_no").alias("last_no"))
    spans = rebal.join(last, "strategy_id").select(
        "strategy_id",
        "tranche_id",
        "seq",
        F.col("day_no").alias("rebalance_no"),
        F.explode(
            F.sequence(F.col("day_no"), F.coalesce(F.col("until_no") - 1, F.col("last_no")))
        ).alias("day_no"),
    )
    return (
        spans.join(
            days.select(
                "strategy_id", "model_id", "day_no", "pred_date", "entry_date", "n_preds",
                "top_k", "holding", "style", "spread", "slippage", "min_rank_drop",
            ),
            ["strategy_id", "day_no"],
        )
        .where(F.col("entry_date").isNotNull())
        # A short day books held names only under block rebalancing.
        .where((F.col("style") == "block") | (F.col("n_preds") >= F.col("top_k")))
    )


def positions(targets: DataFrame, held: DataFrame, returns: DataFrame) -> DataFrame:
    """Held names per strategy, tranche and day with the return realised on the entry date.

    The K names per tranche and day are written first; the panel's returns are then looked up by
    those keys instead of being shuffled.
    """
    r = returns.select("kdcode", F.col("dt").alias("entry_date"), "stock_return")
    names = stable(targets.join(held, ["strategy_id", "tranche_id", "seq"]))
    return lookup(names, r, ["kdcode", "entry_date"])


def tranche_days(pos: DataFrame) -> DataFrame:
    """Mean realised return of a tranche on a day; days without any realised return drop out."""
    return (
        pos.groupBy(
            "strategy_id", "tranche_id", "day_no", "pred_date", "entry_date", "rebalance_no", "seq",
            "style", "holding", "top_k", "spread", "slippage",
        )
        .agg(
            F.avg("stock_return").alias("tranche_return"),
            F.count("stock_return").alias("n_realised"),
            F.count("*").alias("n_held"),
        )
        .where(F.col("n_realised") > 0)
    )


def turnover(holdings: DataFrame, keys: tuple[str, ...], order: str, k: str) -> DataFrame:
    """B5. Names sold, bought and kept between consecutive holding sets, per key and ``order``.

    ``order`` counts the sets 1, 2, 3, ... A name is kept when its previous set is the one before:
    one window per name replaces an outer self-join.
    """
    name = Window.partitionBy(*keys, "kdcode").orderBy(order)
    sets = Window.partitionBy(*keys).orderBy(order)
    per_set = (
        holdings.withColumn("_kept", F.coalesce(F.lag(order).over(name) == F.col(order) - 1, F.lit(False)))
        .groupBy(*keys, order)
        .agg(
            F.count("*").alias("_n"),
            F.count_if("_kept").alias("num_held"),
            F.max(k).alias("_k"),
        )
    )
    bought = F.col("_n") - F.col("num_held")
    sold = F.coalesce(F.lag("_n").over(sets), F.lit(0)) - F.col("num_held")
    return per_set.withColumn("num_sold", sold).withColumn("num_bought", bought).select(
        *keys,
        order,
        "num_sold",
        "num_bought",
        "num_held",
        (F.col("num_sold") + F.col("num_bought")).alias("num_trades"),
        F.greatest("num_sold", "num_bought").alias("num_changes"),
        ((F.col("num_sold") + F.col("num_bought")) / (2.0 * F.greatest(F.col("_k"), F.lit(1)))).alias(
            "one_way_turnover"
        ),
        ((F.col("num_sold") + F.col("num_bought")) / F.greatest(F.col("_k"), F.lit(1)).cast("double")).alias(
            "two_way_turnover"
        ),
    )


def transaction_cost(df: DataFrame) -> DataFrame:
    """B6. Cost of a turnover with its parts; needs one_way_turnover, spread, slippage."""
    t, side = F.col("one_way_turnover"), F.col("spread") / 2 + F.col("slippage")
    return df.select(
        "*",
        (t * side).alias("sell_cost"),
        (t * side).alias("buy_cost"),
        (t * (F.col("spread") + 2 * F.col("slippage"))).alias("total_cost"),
        (t * F.col("spread")).alias("spread_component"),
        (2 * t * F.col("slippage")).alias("slippage_component"),
    )


def numbered_sets(targets: DataFrame, rebal: DataFrame, tranche: DataFrame) -> DataFrame:
    """Holding sets in trading order with their names.

    Staggered and block tranches change state at every rebalance; a daily portfolio changes only on
    days that were booked, so its sets are numbered over booked days.
    """
    booked = tranche.where("day_no = rebalance_no").select("strategy_id", "tranche_id", "seq", F.lit(True).alias("booked"))
    w = Window.partitionBy("strategy_id", "tranche_id").orderBy("seq")
    sets = (
        rebal.select("strategy_id", "tranche_id", "seq", "top_k", "style", "pred_date", "entry_date")
        .join(booked, ["strategy_id", "tranche_id", "seq"], "left")
        .where((F.col("style") != "daily") | F.col("booked"))
        .withColumn("set_no", F.row_number().over(w))
    )
    return targets.join(sets, ["strategy_id", "tranche_id", "seq"])


def portfolio_days(targets: DataFrame, rebal: DataFrame, held: DataFrame, pos: DataFrame, bm: DataFrame) -> DataFrame:
    """B4, B7, B8. One row per strategy and booked day: gross, turnover, cost, net, benchmark."""
    tranche = tranche_days(pos)
    sets = numbered_sets(targets, rebal, tranche)
    turned = turnover(sets, ("strategy_id", "tranche_id"), "set_no", "top_k")
    set_seq = sets.select("strategy_id", "tranche_id", "set_no", "seq").distinct()
    change = turned.join(set_seq, ["strategy_id", "tranche_id", "set_no"]).select(
        "strategy_id", "tranche_id", "seq", "num_trades", "one_way_turnover"
    )
    # The tranche rebuilt on the booked day carries the trades, even if it realised nothing itself.
    rebuilt = (
        held.where("day_no = rebalance_no")
        .select("strategy_id", "tranche_id", "seq", "day_no")
        .join(change, ["strategy_id", "tranche_id", "seq"])
        .select("strategy_id", "day_no", "num_trades", "one_way_turnover")
    )
    parts = F.when(F.col("style") == "staggered", F.col("holding")).otherwise(1)
    traded = F.coalesce(F.col("one_way_turnover"), F.lit(0.0)) / parts
    bm_in = bm.select(F.col("dt").alias("entry_date"), "benchmark_return")
    days = (
        tranche.groupBy(
            "strategy_id", "day_no", "pred_date", "entry_date", "style", "holding", "spread", "slippage"
        )
        .agg(
            F.avg("tranche_return").alias("gross_return"),
            F.count("*").alias("n_tranches"),
            F.sum("n_held").alias("n_held"),
        )
        .join(rebuilt, ["strategy_id", "day_no"], "left")
        .join(bm_in, "entry_date", "left")
    )
    return days.select(
        "strategy_id",
        "pred_date",
        "entry_date",
        "n_tranches",
        "n_held",
        "gross_return",
        traded.alias("turnover"),
        F.coalesce("num_trades", F.lit(0)).alias("num_trades"),
        (traded * (F.col("spread") + 2 * F.col("slippage"))).alias("cost"),
        (F.col("gross_return") - traded * (F.col("spread") + 2 * F.col("slippage"))).alias("net_return"),
        F.coalesce("benchmark_return", F.lit(0.0)).alias("benchmark_return"),
    )


@dataclass(frozen=True)
class Backtest:
    """The lazy tables of one back-test over all strategies of a table."""

    days: DataFrame
    rebal: DataFrame
    targets: DataFrame
    held: DataFrame
    pos: DataFrame
    daily: DataFrame


def backtest(scores: DataFrame, bars: DataFrame, strategies: DataFrame, ranked: DataFrame | None = None) -> Backtest:
    """B4, B7, B8, B15 without a gate: all styles of the strategy table in one plan. K is the largest ``top_k`` there.

    The panel and the scores are read once each: the realised returns and the best names are written
    to the shared folder, and every later step starts from those.
    """
    returns = stable(open_to_open(bars))
    largest = strategies.agg(F.max("top_k").alias("k")).first().k or 1
    best = stable(best_scores(scores, largest)) if ranked is None else ranked.where(F.col("rank") <= largest)
    days = stable(prediction_days(scores if ranked is None else ranked, strategies, entry_dates(returns)))
    rebal = rebalances(days)
    return _book(days, rebal, stable(top_targets(rebal, best)), returns)


def gated_backtest(ranked: DataFrame, bars: DataFrame, strategies: DataFrame) -> Backtest:
    """B10. The same tables when held names leave only after a rank drop."""
    returns = stable(open_to_open(bars))
    days = stable(prediction_days(ranked, strategies, entry_dates(returns)))
    rebal = rebalances(days)
    return _book(days, rebal, stable(gate_targets(ranked, rebal, returns)), returns)


def _book(days: DataFrame, rebal: DataFrame, targets: DataFrame, returns: DataFrame) -> Backtest:
    held = held_days(rebal, days)
    pos = stable(positions(targets, held, returns))  # K names per tranche and day from here on
    return Backtest(days, rebal, targets, held, pos, portfolio_days(targets, rebal, held, pos, benchmark(returns)))


# --- records ---------------------------------------------------------------------------------


def holdings_records(bt: Backtest, ranked: DataFrame) -> DataFrame:
    """B11. Realised holdings with their weight, return and contribution.

    Block holdings weigh 1/n of the names held, the others 1/n of the names realised.
    """
    tr = tranche_days(bt.pos).select("strategy_id", "tranche_id", "day_no", "n_realised", "n_held")
    active = tr.groupBy("strategy_id", "day_no").agg(F.count("*").alias("n_tranches"))
    r = ranked.select("model_id", F.col("dt").alias("pred_date"), "kdcode", "rank", "score")
    weight = 1.0 / (
        F.col("n_tranches") * F.when(F.col("style") == "block", F.col("n_held")).otherwise(F.col("n_realised"))
    )
    # A short day under block rebalancing has scores but no ranking.
    rank = F.when(F.col("n_preds") >= F.col("top_k"), F.col("rank"))
    held = (
        bt.pos.where(F.col("stock_return").isNotNull())
        .join(tr, ["strategy_id", "tranche_id", "day_no"])
        .join(active, ["strategy_id", "day_no"])
    )
    return lookup(stable(held), r, ["model_id", "pred_date", "kdcode"]).select(
        "strategy_id",
        "tranche_id",
        "pred_date",
        "entry_date",
        "kdcode",
        rank.alias("rank"),
        "score",
        weight.alias("weight"),
        "stock_return",
        (F.col("stock_return") * weight).alias("contribution"),
    )


def trade_journal(bt: Backtest, ranked: DataFrame) -> DataFrame:
    """B12. BUY and SELL rows between consecutive holding sets.

    A SELL is the end of a name's run of sets, dated at the next set of the tranche.
    """
    keys = ["strategy_id", "tranche_id"]
    sets = numbered_sets(bt.targets, bt.rebal, tranche_days(bt.pos))
    dates = sets.select(*keys, "set_no", "pred_date", "entry_date").distinct()
    w = Window.partitionBy(*keys, "kdcode").orderBy("set_no")
    runs = sets.select(
        *keys,
        "kdcode",
        "set_no",
        F.coalesce(F.lag("set_no").over(w) == F.col("set_no") - 1, F.lit(False)).alias("kept"),
        F.coalesce(F.lead("set_no").over(w) == F.col("set_no") + 1, F.lit(False)).alias("stays"),
    )
    events = runs.select(
        *keys,
        "kdcode",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("BUY").alias("action"), F.col("set_no").alias("set_no"), (~F.col("kept")).alias("on")),
                    F.struct(F.lit("SELL").alias("action"), (F.col("set_no") + 1).alias("set_no"), (~F.col("stays")).alias("on")),
                ),
                lambda e: e["on"],
            )
        ).alias("e"),
    ).select(*keys, "kdcode", "e.action", "e.set_no")
    model = bt.rebal.select("strategy_id", "model_id").distinct()
    r = ranked.select("model_id", F.col("dt").alias("pred_date"), "kdcode", "rank", "score")
    trades = stable(events.join(dates, [*keys, "set_no"]).join(model, "strategy_id"))
    return lookup(trades, r, ["model_id", "pred_date", "kdcode"]).select(
        *keys, F.coalesce("entry_date", "pred_date").alias("date"), "pred_date", "kdcode", "action", "rank", "score"
    )


def prediction_pairs(scores: DataFrame, returns: DataFrame, label: str) -> DataFrame:
    """B13. Scores with the forward return of their own date, both present."""
    return scores.join(
        returns.select("kdcode", "dt", F.col(label).alias("actual")).where(F.col("actual").isNotNull()),
        ["kdcode", "dt"],
    ).where(F.col("score").isNotNull())


def calendar_returns(daily: DataFrame, bm: DataFrame) -> DataFrame:
    """B14. Every stock date between a strategy's first and last booked day; no trade = 0."""
    span = daily.groupBy("strategy_id").agg(
        F.min("entry_date").alias("first_day"), F.max("entry_date").alias("last_day")
    )
    dates = bm.select("dt", F.coalesce("benchmark_return", F.lit(0.0)).alias("benchmark_return"))
    days = span.select("strategy_id", F.explode(F.sequence("first_day", "last_day")).alias("dt"))
    grid = days.join(dates, "dt").select("strategy_id", "dt", "benchmark_return")
    booked = daily.select("strategy_id", F.col("entry_date").alias("dt"), "net_return")
    return grid.join(booked, ["strategy_id", "dt"], "left").select(
        "strategy_id",
        "dt",
        F.coalesce("net_return", F.lit(0.0)).alias("portfolio_return"),
        "benchmark_return",
    )


# --- rank-drop gate --------------------------------------------------------------------------


def rank_drop_step(ranked: DataFrame, holdings: DataFrame, prev_ranks: DataFrame, strategies: DataFrame) -> DataFrame:
    """B9. One decision per strategy: survivors, exits and entries.

    ranked(model_id, kdcode, score, rank) today; holdings(strategy_id, kdcode[, entry_date]);
    prev_ranks(model_id, kdcode, prev_rank). Only the K best can enter: at most ``survivors`` of
    them are held already, which leaves enough of them for the open slots.
    """
    now = ranked.select("model_id", "kdcode", F.col("rank").alias("curr_rank"))
    before = prev_ranks.select("model_id", "kdcode", "prev_rank")
    on = ["model_id", "kdcode"]
    held = (
        lookup(lookup(holdings.join(strategies, "strategy_id"), now, on), before, on)
        .withColumn("rank_drop", F.col("curr_rank") - F.col("prev_rank"))
        .withColumn(
            "status",
            F.when(F.col("curr_rank").isNull(), "dropped")
            .when(F.col("rank_drop") >= F.col("min_rank_drop"), "exit")
            .otherwise("survivor"),
        )
        .select("strategy_id", "kdcode", "status", "prev_rank", "curr_rank", "rank_drop")
    )
    survivors = held.where("status = 'survivor'")
    kept = survivors.groupBy("strategy_id").agg(F.count("*").alias("n_survivors"))
    w = Window.partitionBy("strategy_id").orderBy("rank")
    entries = (
        ranked.join(strategies, "model_id")
        .where(F.col("rank") <= F.col("top_k"))
        .join(survivors.select("strategy_id", "kdcode"), ["strategy_id", "kdcode"], "left_anti")
        .join(kept, "strategy_id", "left")
        .withColumn("slot", F.row_number().over(w))
        .where(F.col("slot") <= F.col("top_k") - F.coalesce("n_survivors", F.lit(0)))
        .select(
            "strategy_id",
            "kdcode",
            F.lit("entry").alias("status"),
            F.lit(None).cast("bigint").alias("prev_rank"),
            F.col("rank").alias("curr_rank"),
            F.lit(None).cast("bigint").alias("rank_drop"),
        )
    )
    return held.unionByName(entries)


def fold_gate(days: Column, code: str, seq: str, held: Column | None = None) -> Column:
    """Decisions of consecutive days under the rank-drop gate, as an expression over sorted arrays.

    ``days`` is an array of (seq, top_k, min_rank_drop, daily, restart, names), ``names`` of a day an array of (rank,
    kdcode, prev_rank, realises) by rank. The state is the array of held names, at first ``held``: without any, or at a
    restart, the best K enter. A held name stays unless it fell by the limit, and the best others fill the places left.
    With ``daily`` a set that realises nothing is not taken over. Gives an array of (seq, names (kdcode, status, rank)).
    """

    def bind(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def marked(names: Column, status: str) -> Column:
        return F.transform(names, lambda n: F.struct(n["kdcode"].alias("kdcode"), F.lit(status).alias("status"), n["rank"].alias("rank")))

    def day(state: Column, d: Column) -> Column:
        before = F.when(d["restart"], F.expr(f"CAST(array() AS array<{code}>)")).otherwise(state["held"])

        def decided(was: Column) -> Column:
            fell = lambda n: F.coalesce(n["rank"] - n["prev_rank"] >= d["min_rank_drop"], F.lit(False))
            held_now = F.filter(d["names"], lambda n: F.array_contains(was, n["kdcode"]))
            return bind(held_now, lambda h: bind(F.filter(h, lambda n: ~fell(n)), lambda stay: filled(h, stay, fell)))

        def filled(h: Column, stay: Column, fell) -> Column:
            codes = F.transform(stay, lambda n: n["kdcode"])
            free = F.filter(d["names"], lambda n: ~F.array_contains(codes, n["kdcode"]))
            entries = F.slice(free, F.lit(1), F.greatest(F.lit(0), d["top_k"] - F.size(stay)))
            return bind(entries, lambda new: taken(F.filter(h, fell), stay, new))

        def taken(exits: Column, stay: Column, new: Column) -> Column:
            chosen = F.concat(stay, new)
            keep = ~d["daily"] | F.exists(chosen, lambda n: n["realises"])
            rows = F.concat(marked(stay, "survivor"), marked(exits, "exit"), marked(new, "entry"))
            return F.struct(
                F.when(keep, F.transform(chosen, lambda n: n["kdcode"])).otherwise(state["held"]).alias("held"),
                F.concat(state["out"], F.array(F.struct(d["seq"].alias("seq"), rows.alias("names")))).alias("out"),
            )

        return bind(before, decided)

    none = F.expr(f"CAST(array() AS array<{code}>)") if held is None else held
    out = F.expr(f"CAST(array() AS array<struct<seq:{seq},names:array<struct<kdcode:{code},status:string,rank:bigint>>>>)")
    return F.aggregate(days, F.struct(none.alias("held"), out.alias("out")), day, lambda state: state["out"])


def day_arrays(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``days`` of ``fold_gate`` per key, from rows (keys, seq, top_k, min_rank_drop, daily, restart and the names)."""
    names = F.sort_array(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "kdcode", F.col("prev_rank").cast("bigint").alias("prev_rank"), "realises")))
    one = [F.first(c).alias(c) for c in ("top_k", "min_rank_drop", "daily", "restart")]
    daily = rows.groupBy(*keys, "seq").agg(*one, names.alias("names"))
    return daily.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "top_k", "min_rank_drop", "daily", "restart", "names"))).alias("days"))


def gate_rows(ranked: DataFrame, rebal: DataFrame, returns: DataFrame) -> DataFrame:
    """The rows a gate decision can depend on, per (strategy, tranche, rebalance).

    A name matters from a day it is among the K best until it must have left: it is missing or
    falls by the limit on a day that surely changes the holdings. All other rows are dropped before
    the grouped fold, whatever the size of the cross-section.
    """
    gated = rebal.where("min_rank_drop > 0")
    r = ranked.select("model_id", F.col("dt").alias("pred_date"), "kdcode", "rank")
    limit = gated.groupBy("model_id").agg(F.max("top_k").alias("max_k"))
    ever = (
        r.groupBy("model_id", "kdcode")
        .agg(F.min("rank").alias("best"))
        .join(limit, "model_id")
        .where("best <= max_k")
        .select("model_id", "kdcode")
    )
    real = returns.where(F.col("stock_return").isNotNull()).select(
        "kdcode", F.col("dt").alias("entry_date"), F.lit(True).alias("realises")
    )
    days = gated.select("model_id", "pred_date", "entry_date").distinct()
    flagged = (
        r.join(days, ["model_id", "pred_date"])
        .join(real, ["kdcode", "entry_date"], "left")
        .select("model_id", "pred_date", "kdcode", "rank", F.coalesce("realises", F.lit(False)).alias("realises"))
    )
    silent = flagged.groupBy("model_id", "pred_date").agg(F.count_if(~F.col("realises")).alias("n_silent"))
    tranche = Window.partitionBy("strategy_id", "tranche_id").orderBy("seq")
    # Daily holdings change only when something is realised; that is sure when fewer than K names are silent.
    sure = (F.col("style") != "daily") | (F.col("entry_date").isNotNull() & (F.col("n_silent") < F.col("top_k")))
    steps = (
        gated.join(silent, ["model_id", "pred_date"])
        .withColumn("sure", sure)
        .withColumn("sure_upto", F.count_if("sure").over(tranche.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sure_before", F.col("sure_upto") - F.col("sure").cast("int"))
        .withColumn("restart", (F.col("style") == "daily") & (F.col("day_no") - F.col("prev_day_no") > 1))
        .select(
            "strategy_id", "tranche_id", "seq", "model_id", "pred_date", "top_k", "min_rank_drop",
            F.col("style").alias("style"), "sure", "sure_upto", "sure_before",
            F.coalesce("restart", F.lit(False)).alias("restart"),
        )
    )
    rows = flagged.join(ever, ["model_id", "kdcode"], "left_semi").join(steps, ["model_id", "pred_date"])
    name = Window.partitionBy("strategy_id", "tranche_id", "kdcode").orderBy("seq")
    rows = rows.withColumn("prev_rank", F.when(F.lag("seq").over(name) == F.col("seq") - 1, F.lag("rank").over(name)))
    broke = (F.col("sure_before") - F.lag("sure_upto").over(name) > 0) | (
        F.col("sure") & (F.col("rank") - F.col("prev_rank") >= F.col("min_rank_drop"))
    )
    rows = rows.withColumn("_broke", F.coalesce(broke, F.lit(False)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_broke").over(name.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = (
        Window.partitionBy("strategy_id", "tranche_id", "kdcode", "_run")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_live", F.max(F.col("rank") <= F.col("top_k")).over(in_run))
    return (
        rows.withColumn("_was", F.coalesce(F.lag("_live").over(name), F.lit(False)))
        .where("_live OR _was")
        .select(
            "strategy_id", "tranche_id", "seq", "kdcode", "rank", "prev_rank", "realises",
            "top_k", "min_rank_drop", "style", "restart",
        )
    )


def gate_targets(ranked: DataFrame, rebal: DataFrame, returns: DataFrame, with_exits: bool = False) -> DataFrame:
    """B10. Names held under the rank-drop gate; path dependent, so folded per (strategy, tranche)."""
    rows = gate_rows(ranked, rebal, returns).withColumn("daily", F.col("style") == "daily")
    code = ranked.schema["kdcode"].dataType.simpleString()
    day = F.explode(fold_gate(F.col("days"), code, rows.schema["seq"].dataType.simpleString())).alias("day")
    folded = (
        day_arrays(rows, ["strategy_id", "tranche_id"])
        .select("strategy_id", "tranche_id", day)
        .select("strategy_id", "tranche_id", "day.seq", F.explode("day.names").alias("n"))
        .select("strategy_id", "tranche_id", "seq", "n.kdcode", "n.status")
    )
    if with_exits:
        return folded
    return folded.where("status <> 'exit'").select("strategy_id", "tranche_id", "seq", "kdcode")
