"""M1-M4: drift of the daily features after the training period."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import drift as dr
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

FEATS = list(td.FEATURES_D)
BINS = dr.BINS


def train(spark, sf):
    return td.features_d(spark, sf).where(F.col("dt") <= F.lit(td.TRAIN_END).cast("date"))


def later(spark, sf):
    return td.features_d(spark, sf).where(F.col("dt") > F.lit(td.VAL_END).cast("date"))


share("vals", " UNION ALL ".join(f"SELECT '{c}' AS feature, dt, {c}::DOUBLE AS v FROM features_d WHERE {c} IS NOT NULL" for c in FEATS), "features_d")
share(
    "edges",
    f"""WITH q AS (SELECT feature, i, quantile_cont(v, i / 10.0) AS q FROM vals, range(0, 11) r(i) WHERE dt <= DATE '{td.TRAIN_END}' GROUP BY feature, i)
    SELECT a.feature, a.i, max(b.q + (a.i - b.i) * 1e-9) AS e FROM q a JOIN q b ON a.feature = b.feature AND b.i <= a.i GROUP BY 1, 2""",
    "vals",
)
# quantile_cont needs a constant fraction, so the eleven quantiles are listed.
share(
    "edges",
    "WITH q AS (" + " UNION ALL ".join(
        f"SELECT feature, {i} AS i, quantile_cont(v, {i / 10}) AS q FROM vals WHERE dt <= DATE '{td.TRAIN_END}' GROUP BY feature" for i in range(11)
    ) + ") SELECT a.feature, a.i, max(b.q + (a.i - b.i) * 1e-9) AS e FROM q a JOIN q b ON a.feature = b.feature AND b.i <= a.i GROUP BY 1, 2",
    "vals",
)
share("bins", "SELECT a.feature, a.i AS bin, a.e AS lo, b.e AS hi FROM edges a JOIN edges b ON a.feature = b.feature AND b.i = a.i + 1", "edges")
_in = "v.feature = b.feature AND v.v >= b.lo AND (v.v < b.hi OR (b.bin = 9 AND v.v <= b.hi))"
share("ref_counts", f"SELECT b.feature, b.bin, b.lo, b.hi, count(v.v) AS n FROM bins b LEFT JOIN vals v ON {_in} AND v.dt <= DATE '{td.TRAIN_END}' GROUP BY ALL", "bins vals")
share("obs_counts", f"SELECT b.feature, b.bin, count(v.v) AS n FROM bins b LEFT JOIN vals v ON {_in} AND v.dt > DATE '{td.VAL_END}' GROUP BY ALL", "bins vals")


@query("m1_feature_reference", check_sql("ref_counts", f"SELECT feature, bin, {r('lo')} AS lo, {r('hi')} AS hi, n FROM ref_counts"))
def m1(spark, sf):
    ref = dr.feature_reference(train(spark, sf), FEATS)
    out = ref.select("feature", "bins", F.posexplode("counts").alias("bin", "n"))
    return rounded(out.select("feature", "bin", F.col("bins")[F.col("bin")].alias("lo"), F.col("bins")[F.col("bin") + 1].alias("hi"), "n"), "lo", "hi")


@query("m2_histogram", check_sql("obs_counts", "SELECT * FROM obs_counts WHERE n > 0"))
def m2(spark, sf):
    ref = dr.feature_reference(train(spark, sf), FEATS)
    return dr.histogram(dr.feature_values(later(spark, sf), FEATS), ref)


share(
    "drift",
    f"""WITH s AS (SELECT r.feature, r.bin, o.n / greatest(sum(o.n) OVER f, 1e-8) AS o, r.n / greatest(sum(r.n) OVER f, 1e-8) AS e
      FROM ref_counts r JOIN obs_counts o ON o.feature = r.feature AND o.bin = r.bin WINDOW f AS (PARTITION BY r.feature)),
    g AS (SELECT *, abs(sum(o - e) OVER (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)) AS gap FROM s),
    m AS (SELECT feature, sum((greatest(o, 1e-8) - greatest(e, 1e-8)) * ln(greatest(o, 1e-8) / greatest(e, 1e-8))) AS psi, max(gap) AS ks FROM g GROUP BY 1)
    SELECT m.feature, psi, ks, CASE WHEN psi >= 0.25 OR ks >= 0.2 THEN 'ALERT' WHEN psi >= 0.1 OR ks >= 0.1 THEN 'WARN' ELSE 'OK' END AS status,
      (SELECT count(*) FROM vals v WHERE v.feature = m.feature AND v.dt > DATE '{td.VAL_END}') AS observed_count FROM m
    UNION ALL SELECT 'f_new', NULL, NULL, 'NOT_AVAILABLE', (SELECT count(*) FROM vals WHERE feature = 'f_rng' AND dt > DATE '{td.VAL_END}')""",
    "ref_counts obs_counts vals",
)


def rows(spark, sf):
    ref = dr.feature_reference(train(spark, sf), FEATS)
    return dr.drift_rows(later(spark, sf).withColumn("f_new", F.lit(1.0)), ref, [*FEATS, "f_new"])


@query("m3_feature_drift", check_sql("drift", f"SELECT feature, {r('psi')} AS psi, {r('ks')} AS ks, status, observed_count FROM drift"))
def m3(spark, sf):
    return rounded(rows(spark, sf), "psi", "ks")


@query(
    "m4_drift_summary",
    check_sql(
        "drift",
        """SELECT count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'ALERT') AS alert, count(*) FILTER (status = 'NOT_AVAILABLE') AS not_available,
    CASE WHEN bool_or(status = 'ALERT') THEN 'ALERT' WHEN bool_or(status = 'WARN') THEN 'WARN' WHEN bool_or(status = 'OK') THEN 'OK' ELSE 'NOT_AVAILABLE' END AS overall FROM drift""",
    ),
)
def m4(spark, sf):
    return dr.drift_summary(rows(spark, sf))


@query("m4_top_drift", check_sql("drift", f"SELECT feature, {r('psi')} AS psi, {r('ks')} AS ks, status, observed_count FROM drift WHERE psi IS NOT NULL ORDER BY drift.psi DESC, feature LIMIT 2"))
def m4_top(spark, sf):
    return rounded(dr.top_drift(rows(spark, sf), 2), "psi", "ks")
