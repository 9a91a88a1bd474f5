"""Panels, series, scores and strategies derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, gated, last_rows
from rankloom.operators.portfolio import Strategy, strategies_frame
from rankloom.plans.registry import share
from rankloom.schema import safe_div
from rankloom.sources.bars import bars_from_ticks

# Fixed parameters of the registered queries (monthly panel, see SURVEY 7.2).
FAST, SLOW, WEEKLY = 3, 12, 2
HIS_T, LABEL_T, TOP_K = 6, 3, 5
TRAIN_END, VAL_END = "1998-12-31", "1999-12-31"
STRATEGIES = (
    Strategy(1, 1, 5, 1, "daily", 0.0010, 0.0005, 0),
    Strategy(2, 2, 5, 1, "daily", 0.0010, 0.0005, 0),
    Strategy(3, 3, 10, 1, "daily", 0.0005, 0.0, 0),
    Strategy(4, 2, 5, 3, "staggered", 0.0010, 0.0005, 0),
    Strategy(5, 3, 10, 6, "staggered", 0.0, 0.0005, 0),
    Strategy(6, 2, 5, 3, "block", 0.0010, 0.0005, 0),
    Strategy(7, 3, 10, 4, "block", 0.0010, 0.0, 0),
    Strategy(8, 3, 5, 1, "daily", 0.0010, 0.0005, 20),
    Strategy(9, 3, 10, 3, "staggered", 0.0010, 0.0005, 30),
    Strategy(10, 3, 5, 3, "block", 0.0010, 0.0005, 15),
)
REGIME_OF_PRIORITY = {
    "1-URGENT": "regime_market",
    "2-HIGH": "regime_yield_curve",
    "3-MEDIUM": "regime_oil",
    "4-NOT SPECIFIED": "regime_copper",
    "5-LOW": "regime_stock_bond_corr",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: supplier = entity, unit price = price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("kdcode"),
        F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
    )


share(
    "ticks",
    """SELECT l_suppkey AS kdcode, CAST(l_shipdate AS DATE) AS dt, l_orderkey*8+l_linenumber AS seq,
    l_extendedprice/l_quantity AS price, l_quantity AS volume FROM lineitem""",
)


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), ["kdcode", "dt"], "price", "volume", "seq")


def bars_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    # Days are ordered before trades inside a month; one long keeps the aggregation hash-based.
    t = t.withColumn("order", F.unix_date("dt").cast("bigint") * (1 << 44) + F.col("seq"))
    t = t.withColumn("dt", F.trunc("dt", "MM").cast("date"))
    return bars_from_ticks(t, ["kdcode", "dt"], "price", "volume", "order")


share(
    "bars_d",
    """SELECT kdcode, dt, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY kdcode, dt""",
    "ticks",
)
share(
    "bars_m",
    """SELECT kdcode, CAST(date_trunc('month', dt) AS DATE) AS dt, first(price ORDER BY dt, seq) AS open,
    max(price) AS high, min(price) AS low, last(price ORDER BY dt, seq) AS close, sum(volume) AS volume
    FROM ticks GROUP BY 1, 2""",
    "ticks",
)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("kdcode"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
        F.col("event_id"),
    )


def macro_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-wide series of each day: vix, ig_spread, hy_spread."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("dt"))
        .agg(
            F.avg("l_discount").alias("vix"),
            F.avg("l_tax").alias("ig_spread"),
            F.avg(F.col("l_discount") + F.col("l_tax")).alias("hy_spread"),
        )
    )


share(
    "macro_d",
    """SELECT CAST(l_shipdate AS DATE) AS dt, avg(l_discount) AS vix, avg(l_tax) AS ig_spread,
    avg(l_discount + l_tax) AS hy_spread FROM lineitem GROUP BY 1""",
)


def regime_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in REGIME_OF_PRIORITY.items() for x in kv])
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            names[F.col("o_orderpriority")].alias("series_id"),
            F.col("o_orderdate").cast("date").alias("dt"),
        )
        .agg(F.avg("o_totalprice").alias("value"))
    )


def regime_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        regime_long(spark, sf_dir)
        .groupBy("dt")
        .pivot("series_id", list(REGIME_OF_PRIORITY.values()))
        .agg(F.first("value"))
    )


_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIME_OF_PRIORITY.items())
share(
    "regime_long",
    f"""SELECT CASE o_orderpriority {_case} END AS series_id, CAST(o_orderdate AS DATE) AS dt,
    avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""",
)
share(
    "regime_d",
    "SELECT dt, "
    + ", ".join(f"max(value) FILTER (series_id = '{v}') AS {v}" for v in REGIME_OF_PRIORITY.values())
    + " FROM regime_long GROUP BY dt",
    "regime_long",
)


def pit_universe(bars: DataFrame) -> DataFrame:
    return bars.groupBy("kdcode").agg(
        F.date_add(F.min("dt"), 30).alias("valid_from"), F.date_sub(F.max("dt"), 30).alias("valid_to")
    )


share(
    "pit",
    """SELECT kdcode, min(dt) + 30 AS valid_from, max(dt) - 30 AS valid_to
    FROM bars_d GROUP BY kdcode""",
    "bars_d",
)


def returns_m(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    w = by_entity()
    return (bars_m(spark, sf_dir) if bars is None else bars).withColumn(
        "ret", safe_div(F.col("close"), F.lag("close").over(w)) - 1
    )


share(
    "returns_m",
    "SELECT *, close / lag(close) OVER (PARTITION BY kdcode ORDER BY dt) - 1 AS ret FROM bars_m",
    "bars_m",
)


def scores(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Three models: rolling return sums of 1, 3 and 6 months."""
    w = by_entity()
    models = ((1, 1), (2, 3), (3, 6))
    wide = returns_m(spark, sf_dir, bars).select(
        "kdcode", "dt", *[gated(F.sum("ret"), F.col("ret"), last_rows(w, n), n).alias(f"m{m}") for m, n in models]
    )
    by_model = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"m{m}").alias("score")) for m, _ in models])
    return (
        wide.select("kdcode", "dt", F.explode(by_model).alias("s"))
        .select("s.model_id", "dt", "kdcode", "s.score")
        .where(F.col("score").isNotNull())
    )


share(
    "scores",
    """SELECT * FROM (""" + " UNION ALL ".join(
        f"""SELECT {m}::INTEGER AS model_id, dt, kdcode,
        CASE WHEN count(ret) OVER (PARTITION BY kdcode ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n}
        THEN sum(ret) OVER (PARTITION BY kdcode ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS score
        FROM returns_m"""
        for m, n in ((1, 1), (2, 3), (3, 6))
    ) + ") WHERE score IS NOT NULL",
    "returns_m",
)


def forward_m(bars: DataFrame) -> DataFrame:
    """(dt, kdcode, ret): the return of the following month, without its last row per entity."""
    w = by_entity()
    return (
        bars
        .select("kdcode", "dt", (safe_div(F.lead("close").over(w), F.col("close")) - 1).alias("ret"))
        .where(F.col("ret").isNotNull())
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the following month's return, per model."""
    bars = bars_m(spark, sf_dir)
    return scores(spark, sf_dir, bars).join(forward_m(bars), ["dt", "kdcode"])


share(
    "pairs",
    """SELECT s.model_id, s.dt, s.kdcode, s.score, f.ret FROM scores s JOIN
    (SELECT kdcode, dt, lead(close) OVER (PARTITION BY kdcode ORDER BY dt) / close - 1 AS ret FROM bars_m) f
    ON s.kdcode = f.kdcode AND s.dt = f.dt AND f.ret IS NOT NULL""",
    "scores bars_m",
)


def strategies(spark: SparkSession) -> DataFrame:
    return strategies_frame(spark, STRATEGIES)


share(
    "strategies",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({s.strategy_id}, {s.model_id}, {s.top_k}, {s.holding}, '{s.style}', {s.spread}::DOUBLE, {s.slippage}::DOUBLE, {s.min_rank_drop})"
        for s in STRATEGIES
    )
    + ") t(strategy_id, model_id, top_k, holding, style, spread, slippage, min_rank_drop)",
)

FEATURES_D = ("f_ret", "f_rng", "f_vol")


def features_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of the daily panel; the first return of an entity is NULL."""
    w = by_entity()
    return bars_d(spark, sf_dir).select(
        "kdcode",
        "dt",
        "close",
        (safe_div(F.col("close"), F.lag("close").over(w)) - 1).alias("f_ret"),
        safe_div(F.col("high") - F.col("low"), F.col("close")).alias("f_rng"),
        F.col("volume").alias("f_vol"),
    )


share(
    "features_d",
    """SELECT kdcode, dt, close, close / lag(close) OVER (PARTITION BY kdcode ORDER BY dt) - 1 AS f_ret,
    (high - low) / close AS f_rng, volume AS f_vol FROM bars_d""",
    "bars_d",
)


def features_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_entity()
    return returns_m(spark, sf_dir).select(
        "kdcode",
        "dt",
        "close",
        F.col("ret").alias("f_ret"),
        safe_div(F.col("high") - F.col("low"), F.col("close")).alias("f_rng"),
        gated(F.sum("ret"), F.col("ret"), last_rows(w, 3), 3).alias("f_mom"),
    )


share(
    "features_m",
    """SELECT kdcode, dt, close, ret AS f_ret, (high - low) / close AS f_rng,
    CASE WHEN count(ret) OVER (PARTITION BY kdcode ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3
    THEN sum(ret) OVER (PARTITION BY kdcode ORDER BY dt ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS f_mom
    FROM returns_m""",
    "returns_m",
)
FEATURES_M = ("f_ret", "f_rng", "f_mom")

share(
    "windows",
    """WITH b AS (SELECT min(dt) AS lo, max(dt) AS hi FROM bars_m),
    s AS (SELECT lo, hi, i, CAST(lo + INTERVAL (12 * i) MONTH AS DATE) AS train_start FROM b, range(0, 40) r(i)),
    t AS (SELECT *, CAST(train_start + INTERVAL 24 MONTH AS DATE) AS train_end FROM s),
    v AS (SELECT *, train_end + 4 AS val_start, CAST(train_end + 4 + INTERVAL 6 MONTH AS DATE) AS val_end FROM t WHERE train_end < hi),
    x AS (SELECT *, val_end + 4 AS test_start FROM v),
    y AS (SELECT *, least(CAST(test_start + INTERVAL 6 MONTH AS DATE), hi) AS test_end FROM x)
    SELECT row_number() OVER (ORDER BY i) AS window_id, train_start, train_end, val_start, val_end, test_start, test_end
    FROM y WHERE test_end > test_start""",
    "bars_m",
)
