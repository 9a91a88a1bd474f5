"""Evaluation of the monthly scores against the next month's return."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import evaluate as ev
from rankloom.operators.portfolio import best_scores, rank_scores
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

KS = [5, 10, 20]
LAGS = 2


@query(
    "v1_ensemble_mean",
    check_sql("scores", f"SELECT dt, kdcode, {r('avg(score)', 5)} AS score FROM scores GROUP BY 1, 2"),
)
def v1(spark, sf):
    return rounded(ev.ensemble_mean(td.scores(spark, sf)), "score", digits=5)


share(
    "errors",
    "SELECT model_id, avg(power(score - ret, 2)) AS mse, sqrt(avg(power(score - ret, 2))) AS rmse, avg(abs(score - ret)) AS mae, count(*) AS n_pairs FROM pairs GROUP BY 1",
    "pairs",
)


@query("v2_error_metrics", check_sql("errors", f"SELECT model_id, {r('mse')} AS mse, {r('rmse')} AS rmse, {r('mae')} AS mae, n_pairs FROM errors"))
def v2(spark, sf):
    return rounded(ev.error_metrics(td.pairs(spark, sf)), "mse", "rmse", "mae")


share(
    "ic",
    "SELECT model_id, dt, corr(score, ret) AS ic FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_pop(score) > 0 AND stddev_pop(ret) > 0",
    "pairs",
)


@query("v3_daily_ic", check_sql("ic", f"SELECT model_id, dt, {r('ic')} AS ic FROM ic"))
def v3(spark, sf):
    return rounded(ev.daily_ic(td.pairs(spark, sf)), "ic")


def _avg_rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY model_id, dt ORDER BY {c}) + (count(*) OVER (PARTITION BY model_id, dt, {c}) - 1) / 2.0"


share(
    "rank_ic",
    f"""SELECT model_id, dt, corr(rs, rr) AS ic FROM (SELECT model_id, dt, ({_avg_rank('score')})::DOUBLE AS rs, ({_avg_rank('ret')})::DOUBLE AS rr FROM pairs)
    GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_pop(rs) > 0 AND stddev_pop(rr) > 0""",
    "pairs",
)


@query("v4_daily_rank_ic", check_sql("rank_ic", f"SELECT model_id, dt, {r('ic')} AS ic FROM rank_ic"))
def v4(spark, sf):
    return rounded(ev.daily_rank_ic(td.pairs(spark, sf)), "ic")


share(
    "ic_sum",
    "SELECT model_id, avg(ic) AS avg_ic, quantile_cont(ic, 0.5) AS median_ic, avg(ic) / (stddev_pop(ic) + 1e-8) AS ic_ir FROM ic GROUP BY 1",
    "ic",
)


@query("v5_ic_summary", check_sql("ic_sum", f"SELECT model_id, {r('avg_ic')} AS avg_ic, {r('median_ic')} AS median_ic, {r('ic_ir')} AS ic_ir FROM ic_sum"))
def v5(spark, sf):
    return rounded(ev.ic_summary(ev.daily_ic(td.pairs(spark, sf))), "avg_ic", "median_ic", "ic_ir")


share(
    "top_daily",
    f"""SELECT model_id, k, dt, avg(ret) AS r FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dt ORDER BY score DESC, kdcode) AS rank FROM pairs)
    JOIN (SELECT unnest({KS}) AS k) ON rank <= k GROUP BY 1, 2, 3""",
    "pairs",
)


@query("v6_top_k_daily", check_sql("top_daily", f"SELECT model_id, k, dt, {r('r')} AS r FROM top_daily"))
def v6(spark, sf):
    return rounded(ev.top_k_daily(td.pairs(spark, sf), KS), "r")


share(
    "top_metrics",
    "SELECT model_id, k, avg(r) AS avg_return, sum(r) AS cumulative_return, avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252) AS sharpe_naive FROM top_daily GROUP BY 1, 2",
    "top_daily",
)


@query(
    "v7_portfolio_metrics",
    check_sql("top_metrics", f"SELECT model_id, k, {r('avg_return')} AS avg_return, {r('cumulative_return')} AS cumulative_return, {r('sharpe_naive')} AS sharpe_naive FROM top_metrics"),
)
def v7(spark, sf):
    return rounded(ev.portfolio_metrics(ev.top_k_daily(td.pairs(spark, sf), KS)), "avg_return", "cumulative_return", "sharpe_naive")


share(
    "nw",
    f"""WITH c AS (SELECT model_id, k, dt, r, r - avg(r) OVER p AS c, avg(r) OVER p AS m, count(*) OVER p AS n FROM top_daily WINDOW p AS (PARTITION BY model_id, k)),
    l AS (SELECT *, """ + ", ".join(f"c * lag(c, {i}) OVER (PARTITION BY model_id, k ORDER BY dt) AS p{i}" for i in range(1, LAGS + 1)) + """ FROM c),
    s AS (SELECT model_id, k, max(m) AS m, max(n) AS n, sum(c * c) AS p0, """ + ", ".join(f"sum(p{i}) AS p{i}" for i in range(1, LAGS + 1)) + f""" FROM l GROUP BY 1, 2),
    v AS (SELECT *, sqrt(greatest(p0 / n + """ + " + ".join(f"2 * (1 - {i} / {LAGS + 1}.0::DOUBLE) * p{i} / n" for i in range(1, LAGS + 1)) + """, 0)) AS nw_std FROM s)
    SELECT model_id, k, nw_std, CASE WHEN nw_std > 0 THEN m / nw_std * sqrt(252) ELSE 0 END AS sharpe_newey_west FROM v""",
    "top_daily",
)


@query("v8_newey_west", check_sql("nw", f"SELECT model_id, k, {r('nw_std')} AS nw_std, {r('sharpe_newey_west')} AS sharpe_newey_west FROM nw"))
def v8(spark, sf):
    return rounded(ev.newey_west(ev.top_k_daily(td.pairs(spark, sf), KS), LAGS), "nw_std", "sharpe_newey_west")


def _bootstrap_sql(stat: str) -> str:
    return f"""WITH s AS (SELECT model_id, k, r AS x, row_number() OVER (PARTITION BY model_id, k ORDER BY dt) - 1 AS pos, count(*) OVER (PARTITION BY model_id, k) AS n FROM top_daily),
    z AS (SELECT DISTINCT model_id, k, n FROM s), g AS (SELECT z.*, a.i AS rep, b.i AS block FROM z, range(0, 200) a(i), range(0, 1000) b(i) WHERE b.i < ceil(n / 3.0)),
    h0 AS (SELECT *, (42::BIGINT * 1000003 + rep * 7919 + block * 104729) % {ev.HASH_MOD} AS h FROM g),
    h1 AS (SELECT * REPLACE (h * {ev.HASH_A} % {ev.HASH_MOD} AS h) FROM h0), h2 AS (SELECT * REPLACE (xor(h, h >> 13) AS h) FROM h1),
    h3 AS (SELECT * REPLACE (h * {ev.HASH_B} % {ev.HASH_MOD} AS h) FROM h2), h4 AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM h3),
    d AS (SELECT model_id, k, rep, (h % n + o.i) % n AS pos FROM h4, range(0, 3) o(i) WHERE block * 3 + o.i < n),
    t AS (SELECT d.model_id, d.k, d.rep, {stat} AS v FROM d JOIN s ON s.model_id = d.model_id AND s.k = d.k AND s.pos = d.pos GROUP BY 1, 2, 3)
    SELECT model_id, k, {r('quantile_cont(v, 0.025)')} AS ci_lower, {r('quantile_cont(v, 0.975)')} AS ci_upper FROM t GROUP BY 1, 2"""


@query("v9_bootstrap_mean", check_sql("top_daily", _bootstrap_sql("avg(x)")))
def v9(spark, sf):
    return rounded(ev.bootstrap(ev.top_k_daily(td.pairs(spark, sf), KS), 3, 200, 42), "ci_lower", "ci_upper")


@query("v9_bootstrap_column", check_sql("top_daily", _bootstrap_sql("max(x) - min(x)")))
def v9_column(spark, sf):
    df = ev.bootstrap(ev.top_k_daily(td.pairs(spark, sf), KS), 3, 200, 42, statistic=F.max("x") - F.min("x"))
    return rounded(df, "ci_lower", "ci_upper")


@query("v10_hit_rate", check_sql("pairs", f"SELECT model_id, {r('avg(((score > 0) = (ret > 0))::INTEGER)')} AS hit_rate FROM pairs GROUP BY 1"))
def v10(spark, sf):
    return rounded(ev.hit_rate(td.pairs(spark, sf)), "hit_rate")


share(
    "quant",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY model_id, dt ORDER BY score, kdcode) - 1 AS rk, count(*) OVER (PARTITION BY model_id, dt) AS n FROM pairs),
    d AS (SELECT model_id, dt, CASE WHEN n // 5 > 0 THEN least(rk // (n // 5), 4) ELSE 4 END + 1 AS quantile, avg(ret) AS r FROM k GROUP BY 1, 2, 3)
    SELECT model_id, quantile, avg(r) AS mean_return FROM d GROUP BY 1, 2""",
    "pairs",
)


@query("v11_quantile_returns", check_sql("quant", f"SELECT model_id, quantile, {r('mean_return')} AS mean_return FROM quant"))
def v11(spark, sf):
    return rounded(ev.quantile_returns(td.pairs(spark, sf)), "mean_return")


@query(
    "v11_long_short",
    check_sql("quant", f"SELECT model_id, {r('max(mean_return) FILTER (quantile = 5) - max(mean_return) FILTER (quantile = 1)')} AS long_short_spread FROM quant GROUP BY 1"),
)
def v11_spread(spark, sf):
    return rounded(ev.long_short(ev.quantile_returns(td.pairs(spark, sf))), "long_short_spread")


_tops = ", ".join(
    f"max({e}) FILTER (m.k = {k}) AS {n.format(k=k)}"
    for k in KS
    for e, n in (
        ("m.avg_return", "return_top_{k}"), ("n.sharpe_newey_west", "sharpe_top_{k}"),
        ("m.sharpe_naive", "sharpe_top_{k}_naive"), ("n.sharpe_newey_west", "sharpe_top_{k}_newey_west"),
    )
)
_eval_cols = (
    ["mse", "rmse", "mae", "avg_ic", "median_ic", "ic_ir", "avg_spearman_corr", "hit_rate"]
    + [f"quantile_{q}_return" for q in range(1, 6)] + ["long_short_spread"]
    + [n.format(k=k) for k in KS for n in ("return_top_{k}", "sharpe_top_{k}", "sharpe_top_{k}_naive", "sharpe_top_{k}_newey_west")]
)
share("tops", f"SELECT m.model_id, {_tops} FROM top_metrics m JOIN nw n ON n.model_id = m.model_id AND n.k = m.k GROUP BY 1", "top_metrics nw")
share("quant_wide", "SELECT model_id, " + ", ".join(f"max(mean_return) FILTER (quantile = {q}) AS quantile_{q}_return" for q in range(1, 6)) + " FROM quant GROUP BY 1", "quant")
share(
    "evaluation",
    """SELECT *, quantile_5_return - quantile_1_return AS long_short_spread FROM errors JOIN ic_sum USING (model_id)
    JOIN (SELECT model_id, avg(ic) AS avg_spearman_corr FROM rank_ic GROUP BY 1) USING (model_id)
    JOIN (SELECT model_id, avg(((score > 0) = (ret > 0))::INTEGER) AS hit_rate FROM pairs GROUP BY 1) USING (model_id)
    JOIN quant_wide USING (model_id) JOIN tops USING (model_id)""",
    "errors ic_sum rank_ic pairs quant_wide tops",
)


@query("v12_evaluation_row", check_sql("evaluation", "SELECT model_id, " + ", ".join(f"{r(c)} AS {c}" for c in _eval_cols) + " FROM evaluation"))
def v12(spark, sf):
    return rounded(ev.evaluation_row(td.pairs(spark, sf), KS, label_t=3).select("model_id", *_eval_cols), *_eval_cols)


@query(
    "v13_ic_losses",
    check_sql(
        "pairs errors",
        f"""WITH d AS (SELECT model_id, dt, count(*) * covar_pop(score, ret) / ((sqrt(count(*)) * stddev_pop(score) + 1e-8) * (sqrt(count(*)) * stddev_pop(ret) + 1e-8)) AS ic FROM pairs GROUP BY 1, 2),
    m AS (SELECT model_id, avg(ic) AS ic FROM d GROUP BY 1)
    SELECT model_id, {r('mse')} AS mse, {r('-ic')} AS ic_loss, {r('0.5 * mse - 0.5 * ic')} AS combined_loss FROM m JOIN errors USING (model_id)""",
    ),
)
def v13(spark, sf):
    return rounded(ev.ic_losses(td.pairs(spark, sf)), "mse", "ic_loss", "combined_loss")


@query(
    "v14_compare_scores",
    check_sql(
        "scores",
        f"""WITH j AS (SELECT a.model_id, a.dt, abs(a.score - b.score) AS d FROM scores a JOIN scores b ON b.model_id = a.model_id + 1 AND a.dt = b.dt AND a.kdcode = b.kdcode)
    SELECT model_id, dt, count(*) AS n_compared, {r('max(d)')} AS max_diff, {r('avg(d)')} AS avg_diff, max(d) < 2.0 AS matched FROM j GROUP BY 1, 2""",
    ),
)
def v14(spark, sf):
    """Each model against the next one."""
    s = td.scores(spark, sf)
    following = s.withColumn("model_id", F.col("model_id") - 1)
    return rounded(ev.compare_scores(s, following, 2.0, ["model_id"]), "max_diff", "avg_diff")


@query(
    "v15_average_metrics",
    check_sql("top_metrics", f"SELECT k, {r('avg(avg_return)')} AS avg_return, {r('avg(sharpe_naive)')} AS sharpe_naive, count(*) AS n_models FROM top_metrics GROUP BY 1"),
)
def v15(spark, sf):
    m = ev.portfolio_metrics(ev.top_k_daily(td.pairs(spark, sf), KS))
    return rounded(ev.average_metrics(m, ["k"], ["avg_return", "sharpe_naive"]), "avg_return", "sharpe_naive")


share("ranked", "SELECT *, row_number() OVER (PARTITION BY model_id, dt ORDER BY score DESC, kdcode) AS rank FROM scores", "scores")


@query("k2_rank_scores", check_sql("ranked", f"SELECT model_id, dt, kdcode, {r('score')} AS score, rank FROM ranked"))
def k2(spark, sf):
    return rounded(rank_scores(td.scores(spark, sf)), "score")


@query("k3_best_scores", check_sql("ranked", f"SELECT model_id, dt, kdcode, {r('score')} AS score, rank FROM ranked WHERE rank <= {td.TOP_K}"))
def k3(spark, sf):
    return rounded(best_scores(td.scores(spark, sf), td.TOP_K), "score")


@query(
    "k4_top_bottom",
    check_sql(
        "pairs",
        f"""(SELECT 'top' AS side, model_id, dt, kdcode, {r('score')} AS score FROM pairs ORDER BY pairs.score DESC, model_id, dt, kdcode LIMIT 10)
    UNION ALL (SELECT 'bottom', model_id, dt, kdcode, {r('score')} FROM pairs ORDER BY pairs.score, model_id, dt, kdcode LIMIT 10)""",
    ),
)
def k4(spark, sf):
    p = td.pairs(spark, sf).select("model_id", "dt", "kdcode", "score")
    top = p.orderBy(F.desc("score"), "model_id", "dt", "kdcode").limit(10).select(F.lit("top").alias("side"), "*")
    low = p.orderBy("score", "model_id", "dt", "kdcode").limit(10).select(F.lit("bottom").alias("side"), "*")
    return rounded(top.unionByName(low), "score")
