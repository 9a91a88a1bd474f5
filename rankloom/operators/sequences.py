"""Sliding windows, labels, walk-forward windows and naive forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.frames import by_entity, rows_before
from rankloom.functions.groups import attach, calendar, day_numbers, join_dates, one_row
from rankloom.functions.ranking import percent_ranks
from rankloom.operators.clean import densify
from rankloom.schema import safe_div


def sliding_windows(df: DataFrame, features: Sequence[str], his_t: int) -> DataFrame:
    """L1. (kdcode, dt, seq): the ``his_t`` calendar dates before each label date, missing cells and dates as zeros.

    ``seq`` is ordered by date, holds ``array<float>`` rows and never includes the label date. No grid of entities and
    dates is joined: a row knows the gap since the entity's row before it and answers the run of label dates up to the
    next one (the first row also those before it), and zeros are put in while a window is formed.
    """
    numbers = day_numbers(calendar(df))
    dates = numbers.agg(F.sort_array(F.collect_list("dt")).alias("d")).scalar()
    day, zero = F.col("day_no"), F.array(*[F.lit(0.0).cast("float") for _ in features])
    row = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in features])
    w = by_entity(order="day_no")  # numbers grow with the dates
    before, after = F.lag("day_no").over(w), F.lead("day_no").over(w)
    gap = F.coalesce(F.least(day - before - 1, F.lit(his_t)), F.lit(0))
    rows = join_dates(df, numbers).select("kdcode", "day_no", before.alias("before"), after.alias("after"), F.concat(F.array_repeat(zero, gap), F.array(row)).alias("piece"))
    lo = F.greatest(F.when(F.col("before").isNull(), 0).otherwise(day + 1), F.lit(his_t))
    hi = F.coalesce("after", F.size(dates) - 1)
    runs = rows.select(
        "kdcode", "day_no", F.flatten(F.collect_list("piece").over(w.rangeBetween(-(his_t - 1), 0))).alias("recent"),
        F.when(lo <= hi, F.sequence(lo, hi)).alias("labels"),
    ).select("kdcode", "day_no", "recent", F.explode("labels").alias("label"))
    since = F.least(F.col("label") - day - 1, F.lit(his_t))
    filled = F.concat(F.array_repeat(zero, his_t - F.size("recent") - since), F.col("recent"), F.array_repeat(zero, since))
    seq = F.when(F.col("label") <= day, F.array_repeat(zero, his_t)).otherwise(F.slice(filled, -his_t, his_t))
    return runs.select("kdcode", F.get(dates, F.col("label")).alias("dt"), seq.alias("seq"))


def node_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """L2. (kdcode, dt, x): the feature vector of the date itself."""
    x = F.array(*[F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in features])
    return df.select("kdcode", "dt", x.alias("x"))


def forward_labels(df: DataFrame, label_t: int) -> DataFrame:
    """L3. close[t + label_t] / close[t + 1] - 1 on the entity's rows; gaps take the date's mean, then 0."""
    w = by_entity()
    raw = df.select(
        "kdcode", "dt", (safe_div(F.lead("close", label_t).over(w), F.lead("close").over(w)) - 1).alias("label")
    )
    out = attach(raw, ["dt"], _m=F.avg("label"))
    return out.select("kdcode", "dt", F.coalesce("label", "_m", F.lit(0.0)).alias("label"))


def rank_labels(labels: DataFrame) -> DataFrame:
    """L4. Average rank of the label within its date, divided by the count."""
    return percent_ranks(labels, ["dt"], ["label"]).select("kdcode", "dt", F.col("label_pct").alias("label"))


def inference_window(df: DataFrame, features: Sequence[str], his_t: int, target: str | None = None) -> DataFrame:
    """L5. Windows of one date (the last by default) with the date's own features and a length check.

    Only the needed dates reach the grid: the target and the ``his_t`` dates before it.
    """
    dates = calendar(df)
    if target is not None:
        dates = dates.where(F.col("dt") <= F.lit(target).cast("date"))
    needed = dates.orderBy(F.desc("dt")).limit(his_t + 1)
    recent = df.join(needed, "dt", "left_semi")
    n = needed.agg(F.count("*").alias("n")).scalar()
    last = needed.agg(F.max("dt").alias("m")).scalar()
    grid = densify(recent, features)
    row = F.array(*[F.col(c).cast("float") for c in features])
    out = grid.select("kdcode", "dt", row.alias("x"), F.collect_list(row).over(rows_before(by_entity(), his_t)).alias("seq"))
    return out.where(F.col("dt") == last).select("kdcode", "dt", "seq", "x", (n == his_t + 1).alias("complete"))


@dataclass(frozen=True)
class Walkforward:
    """L6 parameters."""

    label_t: int = 5
    train_years: int = 2
    val_months: int = 6
    test_months: int = 6
    step_months: int = 12
    expanding: bool = False
    max_windows: int | None = None

    def __post_init__(self) -> None:
        if min(self.label_t, self.train_years, self.val_months, self.test_months, self.step_months) < 1:
            raise ValueError("walk-forward parameters must be positive")


def walkforward_windows(df: DataFrame, wf: Walkforward, start: str | None = None, end: str | None = None) -> DataFrame:
    """L6. Train, validation and test dates of every window that fits the configured range, or else the panel's.

    With a configured range it is an error if no window fits. A gap of ``label_t + 1`` days separates the periods; the test period is clamped to the end.
    """
    if (start is None) != (end is None):
        raise ValueError("give both ends of the range or none")
    if start is None:
        span = df.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    else:
        span = df.sparkSession.range(1).select(F.lit(start).cast("date").alias("first_dt"), F.lit(end).cast("date").alias("last_dt"))
    step = F.expr(f"interval {wf.step_months} months")
    years = 12 * wf.train_years
    starts = span.where(F.add_months("first_dt", years) < F.col("last_dt")).select(
        "*",
        F.posexplode(
            F.sequence(F.col("first_dt"), F.greatest("first_dt", F.add_months("last_dt", -years)), step)
        ).alias("step", "start"),
    )
    gap = wf.label_t + 1
    d = (
        starts.withColumn("train_start", F.col("first_dt") if wf.expanding else F.col("start"))
        .withColumn("train_end", F.add_months("start", years))
        .withColumn("val_start", F.date_add("train_end", gap))
        .withColumn("val_end", F.add_months("val_start", wf.val_months))
        .withColumn("test_start", F.date_add("val_end", gap))
        .withColumn("test_end", F.least(F.add_months("test_start", wf.test_months), F.col("last_dt")))
        .where((F.col("train_end") < F.col("last_dt")) & (F.col("test_end") > F.col("test_start")))
    )
    w = Window.partitionBy(F.lit(0)).orderBy("step")  # one row per window
    out = d.withColumn("window_id", F.row_number().over(w))
    if wf.max_windows is not None:
        out = out.where(F.col("window_id") <= wf.max_windows)
    out = out.select("window_id", "train_start", "train_end", "val_start", "val_end", "test_start", "test_end")
    if start is not None and out.isEmpty():
        raise ValueError("no walk-forward window fits the range")
    return out


def panel_by_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """L7. Panel rows per window and period; later operators take ``window_id`` as an extra key.

    Windows are matched to the distinct dates first, so the panel is joined by date equality.
    """
    periods = windows.select(
        "window_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("split"), F.col(f"{p}_start").alias("lo"), F.col(f"{p}_end").alias("hi"))
                    for p in ("train", "val", "test")
                ]
            )
        ).alias("p"),
    ).select("window_id", "p.split", F.explode(F.sequence("p.lo", "p.hi")).alias("dt"))
    return df.join(periods, "dt")


def merge_summaries(summaries: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """L8. Mean of every metric over the windows: (metric, mean_value, n_windows)."""
    long = summaries.select(key, *[F.col(c).cast("double") for c in metrics]).unpivot([key], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_windows"))


def naive_forecasts(df: DataFrame, train_end: str, lookback: int | None = None) -> DataFrame:
    """L9. Per row: zero, entity mean, global mean, last value, rolling means and the date's mean of ``ret``."""
    w = by_entity()
    train = df.where(F.col("dt") <= F.lit(train_end).cast("date"))
    if lookback is not None:
        recent = Window.partitionBy("kdcode").orderBy(F.desc("dt"))  # at most one row per date
        train = train.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= lookback).drop("_n")
    means = train.groupBy("kdcode").agg(F.avg("ret").alias("mean_per_entity"))
    total = one_row(train.agg(F.avg("ret").alias("m")))
    zero = F.lit(0.0)
    out = df.select(
        "kdcode",
        "dt",
        "ret",
        zero.alias("zero"),
        F.coalesce(F.lag("ret").over(w), zero).alias("last_return"),
        *[F.coalesce(F.avg("ret").over(rows_before(w, n)), zero).alias(f"rolling_mean_{n}") for n in (5, 10)],
    )
    out = attach(out, ["dt"], cross_sectional_mean=F.avg("ret"))
    return out.join(means, "kdcode", "left").withColumn("global_mean", total["m"])


FORECASTS = (
    "zero", "mean_per_entity", "global_mean", "last_return", "rolling_mean_5", "rolling_mean_10", "cross_sectional_mean",
)


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """L9. Mean squared error of each naive forecast: (baseline, mse)."""
    wide = forecasts.agg(*[F.avg((F.col(c) - F.col("ret")) ** 2).alias(c) for c in FORECASTS])
    return wide.unpivot([], list(FORECASTS), "baseline", "mse")
