"""Experiment results. A run is a (model, K, year) cell of the score evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import evaluate as ev
from rankloom.operators import experiments as ex
from rankloom.plans import q_evaluate  # noqa: F401  (shared fragments)
from rankloom.plans import testdata as td
from rankloom.plans.q_performance import metrics, sweep
from rankloom.plans.registry import check_sql, query, r, rounded, share
from rankloom.session import new_path

KS = [5, 10, 20]


@query(
    "x1_flatten_runs",
    f"""SELECT user_id AS "run.id", count(*) AS "evaluation.metrics.n", {r('avg(value)', 4)} AS "evaluation.metrics.avg", max(value) AS "evaluation.best.value",
    CASE WHEN count(*) > 50 THEN 'OK' ELSE 'FAILED' END AS status FROM events GROUP BY user_id""",
)
def x1(spark, sf):
    per_user = td.table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg"), F.max("value").alias("top")
    )
    nested = per_user.select(
        F.struct(F.col("user_id").alias("id")).alias("run"),
        F.struct(F.struct("n", "avg").alias("metrics"), F.struct(F.col("top").alias("value")).alias("best")).alias("evaluation"),
        F.when(F.col("n") > 50, "OK").otherwise("FAILED").alias("status"),
    )
    path = new_path(spark, "runs")
    nested.write.json(path)
    return ex.read_runs(spark, path)


share(
    "runs",
    """SELECT model_id, k, year(dt) AS yr, avg(r) AS return_top, avg(r) / (stddev_pop(r) + 1e-8) * sqrt(252) AS sharpe_newey_west, min(r) AS ci_lower FROM top_daily GROUP BY 1, 2, 3""",
    "top_daily",
)
share(
    "runs_ic",
    """SELECT t.*, i.avg_ic, s.avg_spearman_corr FROM runs t JOIN (SELECT model_id, year(dt) AS yr, avg(ic) AS avg_ic FROM ic GROUP BY 1, 2) i USING (model_id, yr)
    JOIN (SELECT model_id, year(dt) AS yr, avg(ic) AS avg_spearman_corr FROM rank_ic GROUP BY 1, 2) s USING (model_id, yr)""",
    "runs ic rank_ic",
)


def runs(spark, sf):
    p = td.pairs(spark, sf)
    daily = ev.top_k_daily(p, KS).withColumn("yr", F.year("dt"))
    return daily.groupBy("model_id", "k", "yr").agg(
        F.avg("r").alias("return_top"),
        (F.avg("r") / (F.stddev_pop("r") + 1e-8) * 252**0.5).alias("sharpe_newey_west"),
        F.min("r").alias("ci_lower"),
    )


def runs_ic(spark, sf):
    p = td.pairs(spark, sf)

    def yearly(ic, name):
        return ic.groupBy("model_id", F.year("dt").alias("yr")).agg(F.avg("ic").alias(name))

    out = runs(spark, sf).join(yearly(ev.daily_ic(p), "avg_ic"), ["model_id", "yr"])
    return out.join(yearly(ev.daily_rank_ic(p), "avg_spearman_corr"), ["model_id", "yr"])


def _score(weights: dict[str, float]) -> str:
    return " + ".join(f"{w} * coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)" for c, w in weights.items())


@query(
    "x2_decision_score",
    check_sql("runs_ic", f"SELECT model_id, k, yr, {r(_score(ex.EVALUATION_WEIGHTS))} AS decision_score FROM runs_ic"),
)
def x2(spark, sf):
    df = ex.add_decision_score(runs_ic(spark, sf), ex.EVALUATION_WEIGHTS)
    return rounded(df.select("model_id", "k", "yr", "decision_score"), "decision_score")


_bt = {'m."ASR"': 0.35, "b.avg_excess": 0.30, 'm."MDD"': -0.20, "b.avg_turnover": -0.15}


@query(
    "x2_backtest_score",
    check_sql(
        "metrics bt_daily",
        f"""SELECT m.strategy_id, {r(_score(_bt))} AS decision_score FROM metrics m
    JOIN (SELECT strategy_id, avg(net_return - benchmark_return) AS avg_excess, avg(turnover) AS avg_turnover FROM bt_daily GROUP BY 1) b ON b.strategy_id = m.strategy_id""",
    ),
)
def x2_backtest(spark, sf):
    extra = sweep(spark, sf).groupBy("strategy_id").agg(
        F.avg(F.col("net_return") - F.col("benchmark_return")).alias("excess_return"), F.avg("turnover").alias("avg_daily_turnover")
    )
    df = ex.add_decision_score(metrics(spark, sf).join(extra, "strategy_id"), ex.BACKTEST_WEIGHTS)
    return rounded(df.select("strategy_id", "decision_score"), "decision_score")


@query(
    "x3_recommendation",
    check_sql(
        "runs",
        """SELECT model_id, k, yr, return_top - 0.1 > 0 AS ic_ci_pass, ci_lower + 0.1 > 0 AS top_ci_pass, (return_top - 0.1 > 0) AND (ci_lower + 0.1 > 0) AS both_ci_pass,
    CASE WHEN yr = 1997 THEN 'FAILED' WHEN return_top - 0.1 > 0 AND ci_lower + 0.1 > 0 THEN 'CONTINUE' WHEN return_top - 0.1 > 0 OR ci_lower + 0.1 > 0 THEN 'BORDERLINE' ELSE 'STOP' END AS recommendation FROM runs""",
    ),
)
def x3(spark, sf):
    d = runs(spark, sf).select(
        "model_id", "k", "yr", (F.col("return_top") - 0.1).alias("ic_low"), (F.col("ci_lower") + 0.1).alias("ret_low"),
        F.when(F.col("yr") == 1997, "FAILED").otherwise("OK").alias("status"),
    )
    return ex.add_recommendation(d, "ic_low", "ret_low").drop("ic_low", "ret_low", "status")


@query(
    "x4_main_effects",
    check_sql(
        "runs",
        " UNION ALL ".join(
            f"SELECT '{f}' AS factor, {f}::VARCHAR AS level, {r('avg(return_top)')} AS mean, {r('quantile_cont(return_top, 0.5)')} AS median, count(return_top) AS n_runs FROM runs GROUP BY {f}"
            for f in ("model_id", "k", "yr")
        ),
    ),
)
def x4(spark, sf):
    return rounded(ex.main_effects(runs(spark, sf), ["model_id", "k", "yr"], "return_top"), "mean", "median")


@query(
    "x5_interaction",
    check_sql("runs", "SELECT yr, " + ", ".join(f'{r(f"avg(return_top) FILTER (k = {k})")} AS "{k}"' for k in KS) + " FROM runs GROUP BY yr"),
)
def x5(spark, sf):
    return rounded(ex.interaction(runs(spark, sf), "yr", "k", KS, "return_top"), *[str(k) for k in KS])
