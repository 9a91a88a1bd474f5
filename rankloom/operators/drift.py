"""Feature drift: reference histograms, PSI, KS-like gap and status (M1-M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import exact_quantiles
from rankloom.session import stable

# Limits of the drift status.
PSI_WARN, PSI_ALERT = 0.10, 0.25
KS_WARN, KS_ALERT = 0.10, 0.20
EPS = 1e-8
BINS = 10


def feature_values(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value) rows without NULLs."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    out = df.select(*keys, F.explode(cells).alias("v")).select(*keys, "v.feature", "v.value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def strict_edges(q: Column) -> Column:
    """Edges made strictly increasing; a constant feature gets a small interval around its value."""
    first = q[0]
    flat = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda i: first - 1e-6 + i * (2e-6 / BINS))

    def step(acc: Column, x: Column) -> Column:
        prev = F.try_element_at(acc, F.lit(-1))
        return F.array_append(acc, F.when(prev.isNull() | (x > prev), x).otherwise(prev + 1e-9))

    grown = F.aggregate(q, F.array().cast("array<double>"), step)
    return F.when(F.array_max(q) == F.array_min(q), flat).otherwise(grown)


def bin_of(value: Column, edges: Column) -> Column:
    """0-based bin: left-closed, the last also right-closed; NULL outside the edges."""
    at = F.lit(-1)
    for i in range(BINS):
        at = at + (value >= edges[i]).cast("int")
    return F.when((value >= edges[0]) & (value <= edges[BINS]), at)


def histogram(values: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M2. (keys, feature, bin, n) of the values inside the feature's edges.

    ``edges`` has one row per feature.
    """
    binned = values.join(edges.select("feature", "bins"), "feature").withColumn("bin", bin_of(F.col("value"), F.col("bins")))
    return binned.where(F.col("bin").isNotNull()).groupBy(*keys, "feature", "bin").agg(F.count("*").alias("n"))


def bin_counts(bin_: Column, weight: Column | None = None) -> Column:
    """Aggregate: one array of BINS counts, zeros included."""
    w = F.lit(1) if weight is None else weight
    return F.array(*[F.coalesce(F.sum(F.when(bin_ == i, w)), F.lit(0)).cast("bigint") for i in range(BINS)])


def feature_reference(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """M1. (feature, bins, counts): decile edges and counts of the training rows.

    Quantiles are exact: a sketch brackets them and only values inside the brackets are shuffled. Counts are added up in
    the tasks. The reference is small and is written, as it outlives the training job.
    """
    values = feature_values(train, features)
    q = exact_quantiles(values, ["feature"], "value", [i / BINS for i in range(BINS + 1)])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("q_index", "q"))), lambda s: s["q"])
    edges = stable(q.groupBy("feature").agg(strict_edges(ordered).alias("bins")))  # a row for each feature
    binned = values.join(edges, "feature").withColumn("bin", bin_of(F.col("value"), F.col("bins")))
    counts = binned.groupBy("feature").agg(bin_counts(F.col("bin")).alias("counts"))
    return stable(edges.join(counts, "feature"))


def status(psi: Column, ks: Column) -> Column:
    return (
        F.when(psi.isNull() | ks.isNull(), "NOT_AVAILABLE")
        .when((psi >= PSI_ALERT) | (ks >= KS_ALERT), "ALERT")
        .when((psi >= PSI_WARN) | (ks >= KS_WARN), "WARN")
        .otherwise("OK")
    )


def observed_counts(observed: DataFrame, reference: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, observed, observed_count): bin counts inside the edges and all values, in one pass."""
    values = feature_values(observed, features, keys).join(reference.select("feature", "bins"), "feature", "left")
    binned = values.withColumn("bin", bin_of(F.col("value"), F.col("bins")))
    return binned.groupBy(*keys, "feature").agg(
        bin_counts(F.col("bin")).alias("observed"), F.count("*").alias("observed_count")
    )


def drift_rows(observed: DataFrame, reference: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M3. (keys, feature, psi, ks, status, observed_count) per feature asked for."""
    wanted = observed.select(*keys).distinct() if keys else observed.sparkSession.range(1).select()
    wanted = wanted.select(*keys, F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    counts = observed_counts(observed, reference, features, keys)
    return drift_of_counts(wanted.join(counts, [*keys, "feature"], "left"), reference, keys)


def drift_of_counts(counts: DataFrame, reference: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M3 from bin counts.

    Works on one row of counts per feature: shares, their log ratio and the running gap are array
    expressions.
    """
    d = counts.join(reference, "feature", "left")

    def share(c: str) -> Column:
        total = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
        return F.transform(c, lambda v: v / F.greatest(total.cast("double"), F.lit(EPS)))

    nothing = F.array(*[F.lit(0).cast("bigint")] * BINS)
    d = d.withColumn("observed", F.coalesce("observed", nothing))
    d = d.select("*", share("observed").alias("o"), share("counts").alias("e"))

    def safe(v: Column) -> Column:
        return F.greatest(v, F.lit(EPS))

    psi = F.aggregate(
        F.zip_with("o", "e", lambda o, e: (safe(o) - safe(e)) * F.ln(safe(o) / safe(e))), F.lit(0.0), lambda a, v: a + v
    )
    gap = F.zip_with("o", "e", lambda o, e: o - e)
    ks = F.aggregate(
        gap,
        F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("top")),
        lambda a, v: F.struct((a["run"] + v).alias("run"), F.greatest(a["top"], F.abs(a["run"] + v)).alias("top")),
        lambda a: a["top"],
    )
    known = F.col("counts").isNotNull() & F.col("observed_count").isNotNull()
    d = d.withColumn("psi", F.when(known, psi)).withColumn("ks", F.when(known, ks))
    return d.select(
        *keys, "feature", "psi", "ks", status(F.col("psi"), F.col("ks")).alias("status"),
        F.coalesce("observed_count", F.lit(0)).alias("observed_count"),
    )


def drift_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M4. Worst status with the count of each."""
    s = F.col("status")
    out = rows.groupBy(*keys).agg(*[F.count_if(s == n).alias(n.lower()) for n in ("OK", "WARN", "ALERT", "NOT_AVAILABLE")])
    worst = F.when(F.col("alert") > 0, "ALERT").when(F.col("warn") > 0, "WARN").when(F.col("ok") > 0, "OK").otherwise("NOT_AVAILABLE")
    return out.withColumn("overall", worst)


def top_drift(rows: DataFrame, n: int = 10) -> DataFrame:
    """M4, K4. The features with the largest PSI."""
    return rows.where(F.col("psi").isNotNull()).orderBy(F.desc("psi"), "feature").limit(n)
