"""Normalisation with training statistics or within a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.groups import attach, one_row
from rankloom.functions.normal import norm_ppf
from rankloom.functions.ranking import long_values, percent_ranks, pivoted_ranks, running_total
from rankloom.schema import safe_div
from rankloom.session import stable


def train_stats(df: DataFrame, features: Sequence[str], train_end: str, train_start: str | None = None) -> DataFrame:
    """N1. One row with ``<f>_mean`` and ``<f>_std`` (0 becomes 1) over the training dates.

    Without ``train_start`` every earlier row counts.
    """
    rows = df.where(F.col("dt") <= F.lit(train_end).cast("date"))
    if train_start is not None:
        rows = rows.where(F.col("dt") >= F.lit(train_start).cast("date"))
    std = [F.stddev_samp(c) for c in features]
    return rows.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in features],
        *[F.when(s == 0, 1.0).otherwise(s).alias(f"{c}_std") for c, s in zip(features, std)],
    )


def stats_table(stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """N1 as rows (feature, mean, std), the form that is saved with a run."""
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"))
        for c in features
    ]
    return stats.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def _clipped_z(x: Column, mean: Column, std: Column) -> Column:
    clipped = F.when(x.isNotNull(), F.least(F.greatest(x, mean - 3 * std), mean + 3 * std))
    return safe_div(clipped - mean, std)


def normalise(df: DataFrame, features: Sequence[str], stats: DataFrame) -> DataFrame:
    """N2. Clip to three training deviations and scale; the one-row stats are a scalar subquery."""
    s = one_row(stats)
    out = df.withColumn("_s", s)
    return out.select(
        *[
            _clipped_z(F.col(c), F.col(f"_s.{c}_mean"), F.col(f"_s.{c}_std")).alias(c) if c in features else F.col(c)
            for c in df.columns
        ]
    )


def saved_stats(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """N6. Saved (feature, mean, std) rows back to one row; unknown features are ignored."""
    f = F.col("feature")
    return table.agg(
        *[F.max(F.when(f == c, F.col("mean"))).alias(f"{c}_mean") for c in features],
        *[F.max(F.when(f == c, F.col("std"))).alias(f"{c}_std") for c in features],
    )


def missing_features(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """N6. Features without saved statistics; inference fails when there is any."""
    want = table.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return want.join(table.select("feature"), "feature", "left_anti")


def rank_positions(df: DataFrame, features: Sequence[str], train_end: str, row: Sequence[str] = ("kdcode", "dt")) -> DataFrame:
    """N3. Per feature ``<f>_r`` = training values <= value and ``<f>_n`` = training values; ``row`` identifies a row.

    Distinct values are counted first and a running total over slices of them gives the ranks, so no task ever holds all
    training values of a feature. All features are looked up in one join.
    """
    train = F.col("dt") <= F.lit(train_end).cast("date")
    counts = long_values(df.withColumn("_train", train), features, ["_train"]).groupBy("measure", "value").agg(F.count_if("_train").alias("hits"))
    ranks = running_total(counts, ["measure"], ["value"], F.col("hits"), "r", total="n").select("measure", "value", "r", "n")
    return df.join(pivoted_ranks(df, [], features, ranks, row, {"r": "r", "n": "n"}), list(row), "left")


def uniform_of_rank(r: Column, n: Column) -> Column:
    """N3. (r + 0.5) / (n + 1), kept off 0 and 1."""
    u = (r + 0.5) / (n + 1)
    return F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6)))


def rank_gaussian(df: DataFrame, features: Sequence[str], train_end: str) -> DataFrame:
    """N3. Every feature as the normal quantile of its training rank."""
    out = rank_positions(df, features, train_end)
    return out.select(
        *[
            norm_ppf(uniform_of_rank(F.col(f"{c}_r"), F.col(f"{c}_n"))).alias(c) if c in features else F.col(c)
            for c in df.columns
        ]
    )


def normalise_by_date(df: DataFrame, features: Sequence[str], ddof: int = 1) -> DataFrame:
    """N4. Clip to three deviations of the date, then z-score what is left.

    With ``ddof=0`` a date without spread is only centred; with ``ddof=1`` it gives NULL.
    """
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    first = attach(df, ["dt"], **{f"_{k}_{c}": f(c) for c in features for k, f in (("m", F.avg), ("s", std))})
    clipped = first.select(
        *[
            F.when(
                F.col(c).isNotNull(),
                F.coalesce(
                    F.least(
                        F.greatest(F.col(c), F.col(f"_m_{c}") - 3 * F.col(f"_s_{c}")),
                        F.col(f"_m_{c}") + 3 * F.col(f"_s_{c}"),
                    ),
                    F.col(c),
                ),
            ).alias(c)
            if c in features
            else F.col(c)
            for c in df.columns
        ]
    )
    again = attach(clipped, ["dt"], **{f"_{k}_{c}": f(c) for c in features for k, f in (("m", F.avg), ("s", std))})

    def z(c: str) -> Column:
        centred = F.col(c) - F.col(f"_m_{c}")
        s = F.col(f"_s_{c}")
        return F.when(s > 0, centred / s).otherwise(centred) if ddof == 0 else safe_div(centred, s)

    return again.select(*[z(c).alias(c) if c in features else F.col(c) for c in df.columns])


def daily_percentile(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """N5, K1. Average-rank percentile within the date."""
    return percent_ranks(df, ["dt"], [column]).withColumnRenamed(f"{column}_pct", out)
