"""Normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.normal import ppf_sql
from rankloom.operators import normalize as no
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

FEATS = list(td.FEATURES_D)
END = td.TRAIN_END

share(
    "train_stats",
    "SELECT " + ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS {c}_std" for c in FEATS)
    + f" FROM features_d WHERE dt <= DATE '{END}'",
    "features_d",
)


@query(
    "n1_train_stats",
    check_sql("train_stats", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'{c}_mean')} AS mean, {r(f'{c}_std')} AS std FROM train_stats" for c in FEATS)),
)
def n1(spark, sf):
    return rounded(no.stats_table(no.train_stats(td.features_d(spark, sf), FEATS, END), FEATS), "mean", "std")


_norm = ", ".join(
    f"{r(f'(least(greatest({c}, {c}_mean - 3 * {c}_std), {c}_mean + 3 * {c}_std) - {c}_mean) / {c}_std')} AS {c}"
    if c != "f_ret"
    else r(f"CASE WHEN {c} IS NOT NULL THEN (least(greatest({c}, {c}_mean - 3 * {c}_std), {c}_mean + 3 * {c}_std) - {c}_mean) / {c}_std END") + f" AS {c}"
    for c in FEATS
)


# The statistics beside each row, from the same reading of the panel.
share(
    "scaled_d",
    "SELECT kdcode, dt, " + ", ".join(FEATS) + ", " + ", ".join(
        f"avg({c}) FILTER (dt <= DATE '{END}') OVER () AS {c}_mean, coalesce(nullif(stddev_samp({c}) FILTER (dt <= DATE '{END}') OVER (), 0), 1) AS {c}_std" for c in FEATS
    ) + " FROM features_d",
    "features_d",
)


@query("n2_normalise", check_sql("scaled_d", f"SELECT kdcode, dt, {_norm} FROM scaled_d"))
def n2(spark, sf):
    df = td.features_d(spark, sf)
    out = no.normalise(df, FEATS, no.train_stats(df, FEATS, END))
    return rounded(out.select("kdcode", "dt", *FEATS), *FEATS)


share("train_d", f"SELECT * FROM features_d WHERE dt <= DATE '{END}'", "features_d")
_r = "WITH " + ", ".join(
    f"""d_{c} AS (SELECT {c} AS v, sum(count(*) FILTER (dt <= DATE '{END}')) OVER (ORDER BY {c})::BIGINT AS r FROM features_d WHERE {c} IS NOT NULL GROUP BY {c}),
    n_{c} AS (SELECT count({c}) AS n FROM train_d)"""
    for c in FEATS
)
_rj = " ".join(f"LEFT JOIN d_{c} ON d_{c}.v = f.{c} CROSS JOIN n_{c}" for c in FEATS)


@query(
    "n3_rank_positions",
    check_sql(
        "train_d",
        _r + " SELECT f.kdcode, f.dt, " + ", ".join(
            f"d_{c}.r AS {c}_r, {r(f'least(greatest((d_{c}.r + 0.5) / (n_{c}.n + 1), 1e-6), 1 - 1e-6)')} AS {c}_u" if c != "f_ret"
            else f"d_{c}.r AS {c}_r, {r(f'CASE WHEN d_{c}.r IS NOT NULL THEN least(greatest((d_{c}.r + 0.5) / (n_{c}.n + 1), 1e-6), 1 - 1e-6) END')} AS {c}_u"
            for c in FEATS
        ) + f" FROM features_d f {_rj}",
    ),
)
def n3(spark, sf):
    df = no.rank_positions(td.features_d(spark, sf), FEATS, END)
    us = [no.uniform_of_rank(F.col(f"{c}_r"), F.col(f"{c}_n")).alias(f"{c}_u") for c in FEATS]
    return rounded(df.select("kdcode", "dt", *[f"{c}_r" for c in FEATS], *us), *[f"{c}_u" for c in FEATS])


@query(
    "n3_rank_gaussian",
    check_sql(
        "train_d",
        _r + ", u AS (SELECT f.kdcode, f.dt, " + ", ".join(f"CASE WHEN d_{c}.r IS NOT NULL THEN least(greatest((d_{c}.r + 0.5) / (n_{c}.n + 1), 1e-6), 1 - 1e-6)::DOUBLE END AS {c}" for c in FEATS)
        + f" FROM features_d f {_rj}) SELECT kdcode, dt, " + ", ".join(f"{r(ppf_sql(c))} AS {c}" for c in FEATS) + " FROM u",
    ),
)
def n3_gauss(spark, sf):
    return rounded(no.rank_gaussian(td.features_d(spark, sf), FEATS, END).select("kdcode", "dt", *FEATS), *FEATS)


def _by_date(std: str, final: str) -> str:
    clip = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN coalesce(least(greatest({c}, m_{c} - 3 * s_{c}), m_{c} + 3 * s_{c}), {c}) END AS {c}" for c in FEATS
    )
    stat = ", ".join(
        f"avg({c}) OVER (PARTITION BY dt) AS m_{c}, CASE WHEN count({c}) OVER (PARTITION BY dt) > {1 if std == 'stddev_samp' else 0} THEN {std}({c}) OVER (PARTITION BY dt) END AS s_{c}"
        for c in FEATS
    )
    return f"""WITH a AS (SELECT kdcode, dt, {', '.join(FEATS)}, {stat} FROM features_d), b AS (SELECT kdcode, dt, {clip} FROM a),
    c AS (SELECT kdcode, dt, {', '.join(FEATS)}, {stat} FROM b) SELECT kdcode, dt, """ + ", ".join(f"{r(final.format(c=c), 5)} AS {c}" for c in FEATS) + " FROM c"


@query("n4_by_date", check_sql("features_d", _by_date("stddev_samp", "CASE WHEN round(s_{c}, 12) <> 0 THEN ({c} - m_{c}) / s_{c} END")))
def n4(spark, sf):
    return rounded(no.normalise_by_date(td.features_d(spark, sf).select("kdcode", "dt", *FEATS), FEATS), *FEATS, digits=5)


@query("n4_by_date_population", check_sql("features_d", _by_date("stddev_pop", "CASE WHEN round(s_{c}, 12) > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END")))
def n4_pop(spark, sf):
    return rounded(no.normalise_by_date(td.features_d(spark, sf).select("kdcode", "dt", *FEATS), FEATS, ddof=0), *FEATS, digits=5)


@query(
    "n5_daily_percentile",
    check_sql(
        "features_d",
        f"""SELECT kdcode, dt, {r('(rank() OVER (PARTITION BY dt ORDER BY f_vol) + (count(*) OVER (PARTITION BY dt, f_vol) - 1) / 2.0) / count(*) OVER (PARTITION BY dt)')} AS label
    FROM features_d""",
    ),
)
def n5(spark, sf):
    df = no.daily_percentile(td.features_d(spark, sf).select("kdcode", "dt", "f_vol"), "f_vol")
    return rounded(df.select("kdcode", "dt", "label"), "label")


@query(
    "k1_percent_rank",
    check_sql(
        "features_d",
        f"""SELECT kdcode, dt, {r('CASE WHEN f_ret IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY f_ret NULLS LAST) + (count(*) OVER (PARTITION BY dt, f_ret) - 1) / 2.0) / count(f_ret) OVER (PARTITION BY dt) END')} AS f_ret_pct,
    {r('(rank() OVER (PARTITION BY dt ORDER BY f_vol) + (count(*) OVER (PARTITION BY dt, f_vol) - 1) / 2.0) / count(*) OVER (PARTITION BY dt)')} AS f_vol_pct
    FROM features_d""",
    ),
)
def k1(spark, sf):
    from rankloom.functions.ranking import percent_ranks

    df = percent_ranks(td.features_d(spark, sf).select("kdcode", "dt", "f_ret", "f_vol"), ["dt"], ["f_ret", "f_vol"])
    return rounded(df.select("kdcode", "dt", "f_ret_pct", "f_vol_pct"), "f_ret_pct", "f_vol_pct")


@query("n6_saved_stats", check_sql("scaled_d", f"SELECT kdcode, dt, {_norm} FROM scaled_d WHERE dt > DATE '{END}'"))
def n6(spark, sf):
    df = td.features_d(spark, sf)
    saved = no.stats_table(no.train_stats(df, FEATS, END), FEATS)
    later = df.where(F.col("dt") > F.lit(END).cast("date"))
    return rounded(no.normalise(later, FEATS, no.saved_stats(saved, FEATS)).select("kdcode", "dt", *FEATS), *FEATS)


@query("n6_missing_features", check_sql("train_stats", "SELECT 'f_new' AS feature FROM train_stats"))
def n6_missing(spark, sf):
    saved = no.stats_table(no.train_stats(td.features_d(spark, sf), FEATS, END), FEATS)
    return no.missing_features(saved, [*FEATS, "f_new"])
