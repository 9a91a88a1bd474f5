"""Windows, labels, walk-forward and naive forecasts on the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import sequences as sq
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

WF = sq.Walkforward(label_t=3)
SEQ_FEATURES = ["f_ret", "f_rng"]


def checksum(rows):
    """Position-weighted sum of a window, so that order and content both count."""
    pos = F.transform(rows, lambda x, i: (i + 1) * (x[0].cast("double") + 10 * x[1].cast("double")))
    return F.aggregate(pos, F.lit(0.0), lambda a, v: a + v)


share(
    "grid_m",
    """SELECT k.kdcode, d.dt, coalesce(f.f_ret, 0)::FLOAT::DOUBLE AS f_ret, coalesce(f.f_rng, 0)::FLOAT::DOUBLE AS f_rng
    FROM (SELECT DISTINCT kdcode FROM features_m) k CROSS JOIN (SELECT DISTINCT dt FROM features_m) d
    LEFT JOIN features_m f ON f.kdcode = k.kdcode AND f.dt = d.dt""",
    "features_m",
)
_lags = " + ".join(f"{td.HIS_T + 1 - k} * (lag(f_ret, {k}) OVER w + 10 * lag(f_rng, {k}) OVER w)" for k in range(td.HIS_T, 0, -1))
_seq = f"""SELECT kdcode, dt, {td.HIS_T} AS n_rows, {r(_lags, 4)} AS checksum, {r('lag(f_ret, 1) OVER w')} AS last_ret
    FROM grid_m WINDOW w AS (PARTITION BY kdcode ORDER BY dt) QUALIFY lag(f_ret, {td.HIS_T}) OVER w IS NOT NULL"""


@query("l1_sliding_windows", check_sql("grid_m", _seq))
def l1(spark, sf):
    df = sq.sliding_windows(td.features_m(spark, sf), SEQ_FEATURES, td.HIS_T)
    out = df.select(
        "kdcode", "dt", F.size("seq").alias("n_rows"), checksum(F.col("seq")).alias("checksum"),
        F.element_at("seq", -1)[0].cast("double").alias("last_ret"),
    )
    return rounded(rounded(out, "checksum", digits=4), "last_ret")


@query(
    "l2_node_features",
    check_sql("features_m", f"SELECT kdcode, dt, {r('coalesce(f_ret, 0)::FLOAT')} AS x0, {r('coalesce(f_rng, 0)::FLOAT')} AS x1 FROM features_m"),
)
def l2(spark, sf):
    df = sq.node_features(td.features_m(spark, sf), SEQ_FEATURES)
    out = df.select("kdcode", "dt", F.col("x")[0].cast("double").alias("x0"), F.col("x")[1].cast("double").alias("x1"))
    return rounded(out, "x0", "x1")


share(
    "labels_m",
    f"""WITH x AS (SELECT kdcode, dt, lead(close, {td.LABEL_T}) OVER w / lead(close, 1) OVER w - 1 AS label FROM bars_m WINDOW w AS (PARTITION BY kdcode ORDER BY dt))
    SELECT kdcode, dt, coalesce(label, avg(label) OVER (PARTITION BY dt), 0) AS label FROM x""",
    "bars_m",
)


@query("l3_forward_labels", check_sql("labels_m", f"SELECT kdcode, dt, {r('label')} AS label FROM labels_m"))
def l3(spark, sf):
    return rounded(sq.forward_labels(td.bars_m(spark, sf), td.LABEL_T), "label")


share("raw_labels_m", f"SELECT kdcode, dt, lead(close, {td.LABEL_T}) OVER (PARTITION BY kdcode ORDER BY dt) AS label FROM bars_m", "bars_m")


@query(
    "l4_rank_labels",
    check_sql(
        "raw_labels_m",
        f"""SELECT kdcode, dt, {r('(rank() OVER (PARTITION BY dt ORDER BY label) + (count(*) OVER (PARTITION BY dt, label) - 1) / 2.0) / count(*) OVER (PARTITION BY dt)')} AS label
    FROM raw_labels_m WHERE label IS NOT NULL""",
    ),
)
def l4(spark, sf):
    from rankloom.functions.frames import by_entity

    future = td.bars_m(spark, sf).select("kdcode", "dt", F.lead("close", td.LABEL_T).over(by_entity()).alias("label"))
    return rounded(sq.rank_labels(future.where("label IS NOT NULL")), "label")


@query(
    "l5_inference_window",
    check_sql(
        "features_m",
        f"""WITH d AS (SELECT DISTINCT dt FROM features_m WHERE dt <= DATE '2001-03-01' ORDER BY dt DESC LIMIT {td.HIS_T + 1}),
    grid_m AS (SELECT k.kdcode, d.dt, coalesce(f.f_ret, 0)::FLOAT::DOUBLE AS f_ret, coalesce(f.f_rng, 0)::FLOAT::DOUBLE AS f_rng
      FROM (SELECT DISTINCT kdcode FROM features_m WHERE dt IN (SELECT dt FROM d)) k CROSS JOIN d LEFT JOIN features_m f ON f.kdcode = k.kdcode AND f.dt = d.dt),
    s AS ({_seq}) SELECT s.*, {r('g.f_rng')} AS x1, true AS complete FROM s JOIN grid_m g ON g.kdcode = s.kdcode AND g.dt = s.dt""",
    ),
)
def l5(spark, sf):
    df = sq.inference_window(td.features_m(spark, sf), SEQ_FEATURES, td.HIS_T, "2001-03-01")
    out = df.select(
        "kdcode", "dt", F.size("seq").alias("n_rows"), checksum(F.col("seq")).alias("checksum"),
        F.element_at("seq", -1)[0].cast("double").alias("last_ret"), F.col("x")[1].cast("double").alias("x1"), "complete",
    )
    return rounded(rounded(out, "checksum", digits=4), "last_ret", "x1")


@query("l6_walkforward", check_sql("windows", "SELECT * FROM windows"))
def l6(spark, sf):
    return sq.walkforward_windows(td.bars_m(spark, sf), WF)


share(
    "by_window",
    " UNION ALL ".join(
        f"SELECT w.window_id, '{p}' AS split, f.* FROM features_m f JOIN windows w ON f.dt BETWEEN w.{p}_start AND w.{p}_end" for p in ("train", "val", "test")
    ),
    "features_m windows",
)


@query(
    "l7_panel_by_window",
    check_sql("by_window", f"SELECT window_id, split, kdcode, dt, {r('f_rng')} AS f_rng FROM by_window"),
)
def l7(spark, sf):
    f = td.features_m(spark, sf)
    df = sq.panel_by_window(f, sq.walkforward_windows(td.bars_m(spark, sf), WF))
    return rounded(df.select("window_id", "split", "kdcode", "dt", "f_rng"), "f_rng")


@query(
    "l8_merge_summaries",
    check_sql(
        "by_window",
        f"""WITH s AS (SELECT window_id, avg(f_ret) AS mean_ret, stddev_samp(f_ret) AS vol, avg(f_rng) AS mean_range FROM by_window WHERE split = 'test' GROUP BY window_id),
    u AS (SELECT 'mean_ret' AS metric, mean_ret AS v FROM s UNION ALL SELECT 'vol', vol FROM s UNION ALL SELECT 'mean_range', mean_range FROM s)
    SELECT metric, {r('avg(v)')} AS mean_value, count(v) AS n_windows FROM u GROUP BY metric""",
    ),
)
def l8(spark, sf):
    f = td.features_m(spark, sf)
    df = sq.panel_by_window(f, sq.walkforward_windows(td.bars_m(spark, sf), WF)).where("split = 'test'")
    s = df.groupBy("window_id").agg(
        F.avg("f_ret").alias("mean_ret"), F.stddev_samp("f_ret").alias("vol"), F.avg("f_rng").alias("mean_range")
    )
    return rounded(sq.merge_summaries(s, "window_id", ["mean_ret", "vol", "mean_range"]), "mean_value")


share(
    "naive",
    f"""SELECT r.kdcode, r.dt, r.ret, 0 AS zero, m.m AS mean_per_entity, (SELECT avg(ret) FROM returns_m WHERE dt <= DATE '{td.TRAIN_END}') AS global_mean,
    coalesce(lag(r.ret) OVER (PARTITION BY r.kdcode ORDER BY r.dt), 0) AS last_return,
    coalesce(avg(r.ret) OVER (PARTITION BY r.kdcode ORDER BY r.dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_5,
    coalesce(avg(r.ret) OVER (PARTITION BY r.kdcode ORDER BY r.dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS rolling_mean_10,
    avg(r.ret) OVER (PARTITION BY r.dt) AS cross_sectional_mean
    FROM returns_m r LEFT JOIN (SELECT kdcode, avg(ret) AS m FROM returns_m WHERE dt <= DATE '{td.TRAIN_END}' GROUP BY kdcode) m ON m.kdcode = r.kdcode""",
    "returns_m",
)


@query(
    "l9_naive_forecasts",
    check_sql("naive", "SELECT kdcode, dt, " + ", ".join(f"{r(c)} AS {c}" for c in ("ret", *sq.FORECASTS)) + " FROM naive"),
)
def l9(spark, sf):
    df = sq.naive_forecasts(td.returns_m(spark, sf).select("kdcode", "dt", "ret"), td.TRAIN_END)
    return rounded(df.select("kdcode", "dt", "ret", *sq.FORECASTS), "ret", *sq.FORECASTS)


@query(
    "l9_forecast_errors",
    check_sql(
        "naive",
        " UNION ALL ".join(f"SELECT '{c}' AS baseline, {r(f'avg(power({c} - ret, 2))')} AS mse FROM naive WHERE dt > DATE '{td.VAL_END}'" for c in sq.FORECASTS),
    ),
)
def l9_errors(spark, sf):
    df = sq.naive_forecasts(td.returns_m(spark, sf).select("kdcode", "dt", "ret"), td.TRAIN_END)
    return rounded(sq.forecast_errors(df.where(F.col("dt") > F.lit(td.VAL_END).cast("date"))), "mse")
