"""Cleaning, filters, splits and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import clean
from rankloom.operators.sequences import Walkforward, walkforward_windows
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

SPLIT = clean.Split(("1995-02-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), ("2000-01-01", "2001-10-31"))
INNER = ("1995-02-01", "2001-10-31")


def text_bars(spark, sf):
    b = td.bars_d(spark, sf)
    return b.select(
        F.col("kdcode").alias(" KDCODE "),
        F.col("dt").alias("Dt"),
        F.when(F.col("volume") > 20, F.col("close").cast("string")).otherwise("n/a").alias(" Close"),
        F.when(F.col("volume") < 60, F.col("volume").cast("string")).otherwise("").alias("VOLUME"),
    )


@query(
    "c1_enforce_numeric",
    check_sql("bars_d", f"""SELECT kdcode, dt, {r('close', 7)} AS close, CASE WHEN volume < 60 THEN volume END AS volume
    FROM bars_d WHERE volume > 20"""),
)
def c1(spark, sf):
    return rounded(clean.enforce_numeric(text_bars(spark, sf), ["close", "volume"], ["close"]), "close", digits=7)


@query(
    "c2_drop_incomplete",
    check_sql("features_d", f"SELECT kdcode, dt, {r('f_ret')} AS f_ret, {r('f_rng')} AS f_rng FROM features_d WHERE f_ret IS NOT NULL"),
)
def c2(spark, sf):
    return rounded(clean.drop_incomplete(td.features_d(spark, sf).select("kdcode", "dt", "f_ret", "f_rng")), "f_ret", "f_rng")


@query(
    "c2_clean_report",
    check_sql(
        "features_d",
        """SELECT count(DISTINCT kdcode) AS entities_before, count(DISTINCT kdcode) FILTER (f_ret IS NOT NULL) AS entities_after,
    count(*) AS rows_before, count(f_ret) AS rows_after, count(DISTINCT dt) AS dates_before,
    count(DISTINCT dt) FILTER (f_ret IS NOT NULL) AS dates_after FROM features_d""",
    ),
)
def c2_report(spark, sf):
    return clean.clean_report(td.features_d(spark, sf).select("kdcode", "dt", "f_ret", "f_rng"))


@query(
    "c3_min_history",
    check_sql("bars_d", """SELECT kdcode, count(*) AS n_rows FROM bars_d GROUP BY kdcode HAVING count(*) >= 530"""),
)
def c3(spark, sf):
    return clean.min_history(td.bars_d(spark, sf), 530).groupBy("kdcode").agg(F.count("*").alias("n_rows"))


share(
    "complete_m",
    f"""SELECT kdcode FROM bars_m WHERE dt BETWEEN DATE '{INNER[0]}' AND DATE '{INNER[1]}' GROUP BY kdcode
    HAVING count(*) = (SELECT count(DISTINCT dt) FROM bars_m WHERE dt BETWEEN DATE '{INNER[0]}' AND DATE '{INNER[1]}')""",
    "bars_m",
)


@query(
    "c4_complete_entities",
    check_sql(
        "complete_m",
        f"""SELECT kdcode, dt, {r('close', 7)} AS close FROM bars_m WHERE kdcode IN (SELECT kdcode FROM complete_m)
    AND dt BETWEEN DATE '{INNER[0]}' AND DATE '{INNER[1]}'""",
    ),
)
def c4(spark, sf):
    return rounded(clean.keep_complete(td.bars_m(spark, sf).select("kdcode", "dt", "close"), *INNER), "close", digits=7)


_tag = f"""CASE WHEN dt BETWEEN DATE '{SPLIT.train[0]}' AND DATE '{SPLIT.train[1]}' THEN 'train'
    WHEN dt BETWEEN DATE '{SPLIT.val[0]}' AND DATE '{SPLIT.val[1]}' THEN 'val'
    WHEN dt BETWEEN DATE '{SPLIT.test[0]}' AND DATE '{SPLIT.test[1]}' THEN 'test' END"""


@query(
    "c5_complete_in_every_split",
    check_sql(
        "bars_m",
        f"""WITH t AS (SELECT kdcode, dt, {_tag} AS split FROM bars_m), d AS (SELECT split, count(DISTINCT dt) AS n FROM t WHERE split IS NOT NULL GROUP BY split),
    c AS (SELECT split, kdcode, count(*) AS n FROM t WHERE split IS NOT NULL GROUP BY 1, 2)
    SELECT kdcode FROM c JOIN d ON c.split = d.split AND c.n = d.n GROUP BY kdcode HAVING count(*) = 3""",
    ),
)
def c5(spark, sf):
    return clean.complete_in_every_split(td.bars_m(spark, sf), SPLIT)


@query(
    "c6_common_dates",
    check_sql(
        "bars_m",
        f"""WITH s AS (SELECT kdcode, min(dt) AS lo, max(dt) AS hi FROM bars_m GROUP BY kdcode),
    b AS (SELECT greatest(DATE '1990-01-01', min(lo)) AS lo, least(DATE '2001-10-01', max(hi)) AS hi FROM s),
    c AS (SELECT kdcode FROM s, b WHERE s.lo <= b.lo AND s.hi >= b.hi), k AS (SELECT * FROM bars_m WHERE kdcode IN (SELECT kdcode FROM c))
    SELECT kdcode, dt, {r('close', 7)} AS close FROM k WHERE dt IN (SELECT dt FROM k GROUP BY dt HAVING count(*) = (SELECT count(*) FROM c))""",
    ),
)
def c6(spark, sf):
    df = td.bars_m(spark, sf).select("kdcode", "dt", "close")
    return rounded(clean.common_dates(df, "1990-01-01", "2001-10-01"), "close", digits=7).select("kdcode", "dt", "close")


@query("c7_split_by_period", check_sql("bars_m", f"SELECT kdcode, dt, {_tag} AS split FROM bars_m WHERE {_tag} IS NOT NULL"))
def c7(spark, sf):
    return clean.split_by_period(td.bars_m(spark, sf).select("kdcode", "dt"), SPLIT)


@query(
    "c8_embargo_check",
    check_sql(
        "windows",
        """SELECT window_id, date_diff('day', train_end, val_start) AS train_val_gap, date_diff('day', val_end, test_start) AS val_test_gap,
    date_diff('day', train_end, val_start) > 3 AND date_diff('day', val_end, test_start) > 3 AS valid FROM windows""",
    ),
)
def c8(spark, sf):
    return clean.embargo_check(walkforward_windows(td.bars_m(spark, sf), Walkforward(label_t=3)), 3)


@query(
    "c9_point_in_time",
    check_sql(
        "pit",
        f"""SELECT b.kdcode, b.dt, {r('b.close', 7)} AS close FROM bars_d b WHERE EXISTS
    (SELECT 1 FROM pit p WHERE p.kdcode = b.kdcode AND b.dt BETWEEN p.valid_from AND p.valid_to)""",
    ),
)
def c9(spark, sf):
    b = td.bars_d(spark, sf)
    return rounded(clean.point_in_time(b.select("kdcode", "dt", "close"), td.pit_universe(b)), "close", digits=7)


@query(
    "c10_impute",
    check_sql(
        "features_m",
        f"""SELECT kdcode, dt, {r('coalesce(f_ret, avg(f_ret) OVER (PARTITION BY dt), 0)')} AS f_ret,
    {r('coalesce(f_mom, avg(f_mom) OVER (PARTITION BY dt), 0)')} AS f_mom FROM features_m""",
    ),
)
def c10(spark, sf):
    df = td.features_m(spark, sf).select("kdcode", "dt", "f_ret", "f_mom")
    return rounded(clean.impute(df, ["f_ret", "f_mom"]), "f_ret", "f_mom")


@query(
    "c11_join_series",
    check_sql("bars_d macro_d", f"SELECT b.kdcode, b.dt, {r('m.vix')} AS vix, {r('m.hy_spread')} AS hy_spread FROM bars_d b LEFT JOIN macro_d m ON m.dt = b.dt AND day(b.dt) <> 7"),
)
def c11(spark, sf):
    m = td.macro_d(spark, sf).where(F.dayofmonth("dt") != 7).select("dt", "vix", "hy_spread")
    return rounded(clean.join_series(td.bars_d(spark, sf).select("kdcode", "dt"), m), "vix", "hy_spread")


_month_end = "SELECT max(dt) AS dt, arg_max(vix, dt) AS vix FROM macro_d GROUP BY date_trunc('month', dt)"


@query(
    "c12_asof_dates",
    check_sql(
        "bars_d macro_d",
        f"WITH me AS ({_month_end}) SELECT b.kdcode, b.dt, {r('m.vix')} AS vix FROM bars_d b ASOF LEFT JOIN me m ON b.dt >= m.dt",
    ),
)
def c12(spark, sf):
    monthly = td.macro_d(spark, sf).groupBy(F.trunc("dt", "MM")).agg(F.max("dt").alias("dt"), F.max_by("vix", "dt").alias("vix"))
    return rounded(clean.asof_dates(td.bars_d(spark, sf).select("kdcode", "dt"), monthly.select("dt", "vix")), "vix")


@query(
    "c12_asof_by_key",
    check_sql(
        "bars_d bars_m",
        f"""SELECT b.kdcode, b.dt, {r('b.close', 7)} AS close, {r('m.close', 7)} AS month_close
    FROM bars_d b ASOF LEFT JOIN bars_m m ON b.kdcode = m.kdcode AND b.dt >= m.dt + 20""",
    ),
)
def c12_key(spark, sf):
    right = td.bars_m(spark, sf).select("kdcode", F.date_add("dt", 20).alias("dt"), F.col("close").alias("month_close"))
    return rounded(clean.asof_by_key(td.bars_d(spark, sf).select("kdcode", "dt", "close"), right), "close", "month_close", digits=7)


@query(
    "c13_densify",
    check_sql(
        "returns_m",
        f"""SELECT k.kdcode, d.dt, {r('coalesce(x.ret, 0)')} AS ret FROM (SELECT DISTINCT kdcode FROM returns_m) k
    CROSS JOIN (SELECT DISTINCT dt FROM returns_m) d LEFT JOIN returns_m x ON x.kdcode = k.kdcode AND x.dt = d.dt""",
    ),
)
def c13(spark, sf):
    return rounded(clean.densify(td.returns_m(spark, sf), ["ret"]), "ret")


@query(
    "c14_keep_last",
    check_sql("ticks", f"SELECT kdcode, dt, max(seq) AS seq, {r('arg_max(price, seq)', 7)} AS price FROM ticks GROUP BY 1, 2"),
)
def c14(spark, sf):
    return rounded(clean.resolve_duplicates(td.ticks(spark, sf).select("kdcode", "dt", "seq", "price"), "seq"), "price", digits=7)


@query(
    "c14_keep_first",
    check_sql("ticks", f"SELECT kdcode, dt, min(seq) AS seq, {r('arg_min(price, seq)', 7)} AS price FROM ticks GROUP BY 1, 2"),
)
def c14_first(spark, sf):
    return rounded(
        clean.resolve_duplicates(td.ticks(spark, sf).select("kdcode", "dt", "seq", "price"), "seq", "first"), "price", digits=7
    )


_ohlcv = ("open", "high", "low", "close", "volume")


@query(
    "c15_quality_report",
    check_sql(
        "bars_d",
        "WITH b AS (SELECT kdcode, dt, open, high, low, CASE WHEN volume > 25 THEN close END AS close, volume FROM bars_d), "
        "l AS (SELECT * FROM b WHERE dt = (SELECT max(dt) FROM b)), c AS ("
        "SELECT 'new_dates' AS check_name, count(DISTINCT dt)::DOUBLE AS value, 1::DOUBLE AS threshold, count(DISTINCT dt) >= 1 AS passed FROM b WHERE dt > DATE '2001-10-31' "
        "UNION ALL SELECT 'entities', count(DISTINCT kdcode)::DOUBLE, 96::DOUBLE, count(DISTINCT kdcode) >= 96 FROM b "
        + " ".join(f"UNION ALL SELECT 'null_{c}', avg(({c} IS NULL)::INTEGER), 0.05::DOUBLE, avg(({c} IS NULL)::INTEGER) <= 0.05 FROM l" for c in _ohlcv)
        + f") SELECT check_name, {r('value')} AS value, {r('threshold')} AS threshold, passed FROM c",
    ),
)
def c15(spark, sf):
    b = td.bars_d(spark, sf).withColumn("close", F.when(F.col("volume") > 25, F.col("close")))
    return rounded(clean.quality_report(b, 120, "2001-10-31"), "value", "threshold")


@query(
    "c16_coverage",
    check_sql(
        "bars_d",
        f"""WITH q AS (SELECT s_suppkey AS kdcode FROM supplier), f AS (SELECT DISTINCT kdcode FROM bars_d WHERE dt < DATE '1995-01-20')
    SELECT count(*) AS requested, count(f.kdcode) AS fetched, {r('count(f.kdcode)::DOUBLE / count(*)')} AS coverage,
    count(f.kdcode)::DOUBLE / count(*) >= 0.8 AS passed FROM q LEFT JOIN f ON q.kdcode = f.kdcode""",
    ),
)
def c16(spark, sf):
    want = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("kdcode"))
    have = td.bars_d(spark, sf).where("dt < DATE '1995-01-20'")
    return rounded(clean.coverage(want, have), "coverage")


@query(
    "c16_missing_entities",
    check_sql("bars_d", "SELECT s_suppkey AS kdcode FROM supplier WHERE s_suppkey NOT IN (SELECT kdcode FROM bars_d WHERE dt < DATE '1995-01-20')"),
)
def c16_missing(spark, sf):
    want = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("kdcode"))
    return clean.missing_entities(want, td.bars_d(spark, sf).where("dt < DATE '1995-01-20'"))


@query("c17_last_dates", check_sql("ticks", "SELECT DISTINCT dt FROM ticks ORDER BY dt DESC LIMIT 5"))
def c17(spark, sf):
    return clean.last_dates(td.ticks(spark, sf), 5)


@query(
    "c17_previous_dates",
    check_sql("ticks", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS prev_dt FROM (SELECT DISTINCT dt FROM ticks)"),
)
def c17_prev(spark, sf):
    return clean.previous_dates(td.ticks(spark, sf))


@query("c17_dates_after", check_sql("ticks", "SELECT DISTINCT dt FROM ticks WHERE dt > DATE '2001-06-30'"))
def c17_after(spark, sf):
    return clean.dates_after(td.ticks(spark, sf), "2001-06-30")


@query(
    "c18_largest_at",
    check_sql(
        "bars_d",
        f"""WITH n AS (SELECT * FROM bars_d WHERE dt BETWEEN DATE '1999-06-23' AND DATE '1999-07-07'),
    p AS (SELECT kdcode, coalesce(arg_max(close, dt) FILTER (dt <= DATE '1999-06-30'), arg_min(close, dt) FILTER (dt > DATE '1999-06-30')) AS price FROM n GROUP BY kdcode)
    SELECT kdcode, {r('price', 7)} AS price, s_acctbal AS shares, {r('price * s_acctbal', 2)} AS size FROM p JOIN supplier ON s_suppkey = kdcode
    WHERE s_acctbal > 0 ORDER BY price * s_acctbal DESC, kdcode LIMIT 20""",
    ),
)
def c18(spark, sf):
    shares = td.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("kdcode"), F.col("s_acctbal").alias("shares"))
    df = clean.largest_at(td.bars_d(spark, sf), shares, "1999-06-30", 20)
    return rounded(rounded(df, "price", digits=7), "size", digits=2)


@query(
    "c19_keep_members",
    check_sql("bars_m", f"SELECT kdcode, dt, {r('close', 7)} AS close FROM bars_m WHERE kdcode IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"),
)
def c19(spark, sf):
    members = td.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("kdcode"))
    return rounded(clean.keep_members(td.bars_m(spark, sf).select("kdcode", "dt", "close"), members), "close", digits=7)
