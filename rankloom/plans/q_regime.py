"""Regime similarity on the priorities of orders as macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import regime as re
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

VARS = list(td.REGIME_OF_PRIORITY.values())
P = re.Regime(horizons=(1, 3))
LEAST = max(P.min_history, P.change + 1)

share(
    "month_ends",
    "SELECT last_day(dt) AS dt, " + ", ".join(f"arg_max({v}, dt) FILTER ({v} IS NOT NULL) AS {v}" for v in VARS) + " FROM regime_d GROUP BY 1",
    "regime_d",
)


@query("g1_month_ends", check_sql("month_ends", "SELECT dt, " + ", ".join(f"{r(v, 3)} AS {v}" for v in VARS) + " FROM month_ends"))
def g1(spark, sf):
    return rounded(re.month_ends(td.regime_d(spark, sf)), *VARS, digits=3)


share("month_change", "SELECT dt, " + ", ".join(f"{v} - lag({v}, {P.change}) OVER (ORDER BY dt) AS {v}" for v in VARS) + " FROM month_ends", "month_ends")
_w = f"(ORDER BY dt ROWS BETWEEN {P.window - 1} PRECEDING AND CURRENT ROW)"
share(
    "month_states",
    "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS idx, "
    + ", ".join(
        f"CASE WHEN count({v}) OVER {_w} >= {LEAST} AND {v} IS NOT NULL THEN least(greatest(({v} - avg({v}) OVER {_w}) / (stddev_samp({v}) OVER {_w} + 1e-8), -3), 3) END AS {v}"
        for v in VARS
    )
    + " FROM month_change",
    "month_change",
)


@query("g2_monthly_states", check_sql("month_states", "SELECT dt, " + ", ".join(f"{r(v)} AS {v}" for v in VARS) + " FROM month_states"))
def g2(spark, sf):
    return rounded(re.monthly_states(re.month_ends(td.regime_d(spark, sf)), P), *VARS)


_sq = " + ".join(f"coalesce(power(t.{v} - h.{v}, 2), 0)" for v in VARS)
_any = " OR ".join(f"(t.{v} IS NOT NULL AND h.{v} IS NOT NULL)" for v in VARS)
share(
    "month_distances",
    f"SELECT t.dt, t.idx, h.idx AS past, sqrt({_sq}) AS distance FROM month_states t JOIN month_states h ON h.idx < t.idx - {P.exclusion} WHERE {_any}",
    "month_states",
)


@query("g3_distances", check_sql("month_distances", f"SELECT dt, idx, past, {r('distance')} AS distance FROM month_distances"))
def g3(spark, sf):
    return rounded(re.month_distances(re.monthly_states(re.month_ends(td.regime_d(spark, sf)), P), P), "distance")


share(
    "regime_monthly",
    """SELECT m.dt, s.* EXCLUDE (dt) FROM month_ends m LEFT JOIN (
    WITH f AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS past, lead(regime_market, 1) OVER (ORDER BY dt) / regime_market - 1 AS f1,
      lead(regime_market, 3) OVER (ORDER BY dt) / regime_market - 1 AS f3 FROM month_ends),
    k AS (SELECT d.*, f.f1, f.f3, row_number() OVER (PARTITION BY d.dt ORDER BY d.distance, d.past) AS pos, count(*) OVER (PARTITION BY d.dt) AS n
      FROM month_distances d JOIN f ON f.past = d.past),
    q AS (SELECT *, greatest(1, floor(n * 0.2)) AS q FROM k WHERE n >= 24)
    SELECT dt, avg(distance) AS regime_global_score, avg(distance) FILTER (pos <= q) AS regime_similarity_q20_mean,
      avg(distance) FILTER (pos > n - q) AS regime_dissimilarity_q80_mean,
      avg(distance) FILTER (pos > n - q) - avg(distance) FILTER (pos <= q) AS regime_similarity_spread,
      avg(f1) FILTER (pos <= q) AS regime_similar_subsequent_return_1m, avg(f3) FILTER (pos <= q) AS regime_similar_subsequent_return_3m,
      avg(f1) FILTER (pos <= q) - avg(f1) FILTER (pos > n - q) AS regime_subsequent_return_spread_1m FROM q GROUP BY dt) s ON s.dt = m.dt""",
    "month_ends month_distances",
)
COLS = re.regime_columns()


@query("g4_similarity", check_sql("regime_monthly", "SELECT dt, " + ", ".join(f"{r(c)} AS {c}" for c in COLS[:4]) + " FROM regime_monthly"))
def g4(spark, sf):
    p = re.Regime(subsequent=False)
    return rounded(re.regime_features(td.regime_d(spark, sf), p), *COLS[:4])


@query("g5_subsequent_returns", check_sql("regime_monthly", "SELECT dt, " + ", ".join(f"{r(c)} AS {c}" for c in COLS) + " FROM regime_monthly"))
def g5(spark, sf):
    return rounded(re.regime_features(td.regime_d(spark, sf), P), *COLS)


_carried = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in COLS
)


@query(
    "g6_panel_regime",
    check_sql(
        "bars_d regime_monthly",
        f"WITH m AS (SELECT dt, {_carried} FROM regime_monthly) SELECT b.kdcode, b.dt, "
        + ", ".join(f"{r(f'coalesce(m.{c}, 0)')} AS {c}" for c in COLS)
        + " FROM bars_d b ASOF LEFT JOIN m ON b.dt >= m.dt",
    ),
)
def g6(spark, sf):
    return rounded(re.add_regime_features(td.bars_d(spark, sf).select("kdcode", "dt"), td.regime_d(spark, sf), P), *COLS)


_G7 = ["regime_global_score", "regime_similarity_q20_mean", "regime_dissimilarity_q80_mean", "regime_similarity_spread",
       "regime_similar_subsequent_return_3m", "regime_similar_subsequent_return_1m", "regime_subsequent_return_spread_1m"]


@query(
    "g7_configured_columns",
    check_sql(
        "regime_monthly",
        " UNION ALL ".join(f"SELECT dt, CAST({k} AS INTEGER) AS position, '{c}' AS feature, {r(c)} AS value FROM regime_monthly" for k, c in enumerate(_G7))
        + " UNION ALL " + " UNION ALL ".join(f"SELECT dt, CAST({100 + k} AS INTEGER), '{c}', {r(c)} FROM regime_monthly" for k, c in enumerate(_G7[:4])),
    ),
)
def g7(spark, sf):
    """Horizons given in another order and twice, and none at all: which columns come, where, and with which values."""
    out = None
    for first, p in ((0, re.Regime(horizons=(3, 1, 3))), (100, re.Regime(subsequent=False))):
        wide = re.regime_features(td.regime_d(spark, sf), p)
        cells = F.array(*[F.struct(F.lit(first + k).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("value")) for k, c in enumerate(wide.columns[1:])])
        rows = wide.select("dt", F.explode(cells).alias("c")).select("dt", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "value")
