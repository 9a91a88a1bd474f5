"""Cleaning, filters, splits and joins of the panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.groups import attach, calendar, join_dates, join_series_dates, keep_last, one_row
from rankloom.schema import OHLCV, clean_double, require_columns


def day(d: str | date):
    return F.lit(str(d)).cast("date")


def enforce_numeric(df: DataFrame, numeric: Sequence[str], required: Sequence[str]) -> DataFrame:
    """C1. Trim and lower-case names, coerce numbers, drop rows without a required value."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    require_columns(named, [*numeric, *required])
    typed = named.select(*[clean_double(c).alias(c) if c in numeric else F.col(c) for c in named.columns])
    return typed.dropna("any", subset=list(required))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """C2. Rows without any NULL."""
    return df.dropna("any")


def clean_report(df: DataFrame) -> DataFrame:
    """C2. Entities, dates and rows before and after dropping incomplete rows, in one pass.

    Distinct entities are counted by grouping first: Spark then spreads them over the tasks.
    """
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & F.col(c).isNotNull()
    flagged = df.select("kdcode", "dt", complete.alias("ok"))
    by_pair = F.count_if("ok").alias("n_ok"), F.count("*").alias("n")
    ent = flagged.groupBy("kdcode").agg(*by_pair).agg(
        F.count("kdcode").alias("entities_before"),
        F.count_if(F.col("n_ok") > 0).alias("entities_after"),
        F.sum("n").alias("rows_before"),
        F.sum("n_ok").alias("rows_after"),
    )
    days = flagged.groupBy("dt").agg(*by_pair).agg(
        F.count("dt").alias("dates_before"), F.count_if(F.col("n_ok") > 0).alias("dates_after")
    )
    d = one_row(days)
    return ent.withColumn("_d", d).select("*", "_d.dates_before", "_d.dates_after").drop("_d")


def min_history(df: DataFrame, min_rows: int) -> DataFrame:
    """C3. Entities with at least ``min_rows`` rows."""
    enough = df.groupBy("kdcode").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return df.join(enough.select("kdcode"), "kdcode", "left_semi")


def complete_entities(df: DataFrame, start: str, end: str) -> DataFrame:
    """C4. Entities with one row per date of the period: (kdcode). Expects unique (kdcode, dt)."""
    period = df.where(F.col("dt").between(day(start), day(end)))
    n_dates = calendar(period).agg(F.count("*").alias("n")).scalar()
    return period.groupBy("kdcode").agg(F.count("*").alias("n")).where(F.col("n") == n_dates).select("kdcode")


def keep_complete(df: DataFrame, start: str, end: str) -> DataFrame:
    period = df.where(F.col("dt").between(day(start), day(end)))
    return period.join(complete_entities(df, start, end), "kdcode", "left_semi")


@dataclass(frozen=True)
class Split:
    """Date ranges of the three periods."""

    train: tuple[str, str]
    val: tuple[str, str]
    test: tuple[str, str]

    def __post_init__(self) -> None:
        ends = [*self.train, *self.val, *self.test]
        if ends != sorted(ends):
            raise ValueError("periods must be in order and not overlap")

    def column(self, dt: str = "dt"):
        c = F.col(dt)
        return (
            F.when(c.between(day(self.train[0]), day(self.train[1])), "train")
            .when(c.between(day(self.val[0]), day(self.val[1])), "val")
            .when(c.between(day(self.test[0]), day(self.test[1])), "test")
        )


def split_by_period(df: DataFrame, split: Split) -> DataFrame:
    """C7. Rows of the three periods with a ``split`` column."""
    return df.withColumn("split", split.column()).where(F.col("split").isNotNull())


def complete_in_every_split(df: DataFrame, split: Split) -> DataFrame:
    """C5. Entities complete in train, val and test alike: (kdcode)."""
    tagged = split_by_period(df.select("kdcode", "dt"), split)
    dates = tagged.select("split", "dt").distinct().groupBy("split").agg(F.count("*").alias("n_dates"))
    rows = tagged.groupBy("split", "kdcode").agg(F.count("*").alias("n"))
    full = rows.join(dates, "split").where(F.col("n") == F.col("n_dates"))
    return full.groupBy("kdcode").agg(F.count("*").alias("n_splits")).where("n_splits = 3").select("kdcode")


def common_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """C6. Entities that cover [start, end] on the dates all of them share.

    A bound beyond the data is moved to the first or last date of the panel.
    """
    spans = df.groupBy("kdcode").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
    bounds = one_row(
        spans.agg(
            F.greatest(day(start), F.min("first_dt")).alias("lo"), F.least(day(end), F.max("last_dt")).alias("hi")
        )
    )
    cover = spans.where((F.col("first_dt") <= bounds["lo"]) & (F.col("last_dt") >= bounds["hi"])).select("kdcode")
    kept = df.join(cover, "kdcode", "left_semi")
    n = cover.agg(F.count("*").alias("n")).scalar()
    shared = kept.groupBy("dt").agg(F.count("*").alias("c")).where(F.col("c") == n).select("dt")
    return kept.join(shared, "dt", "left_semi")


def embargo_check(windows: DataFrame, label_t: int) -> DataFrame:
    """C8. Gap days between periods; valid when both exceed ``label_t``."""
    return windows.select(
        "window_id",
        F.datediff("val_start", "train_end").alias("train_val_gap"),
        F.datediff("test_start", "val_end").alias("val_test_gap"),
    ).withColumn("valid", (F.col("train_val_gap") > label_t) & (F.col("val_test_gap") > label_t))


def point_in_time(df: DataFrame, universe: DataFrame, dedupe: bool = True) -> DataFrame:
    """C9. Rows inside a membership interval of their entity; ``dedupe=False`` repeats overlaps."""
    u = universe.select(F.col("kdcode").alias("_k"), "valid_from", "valid_to")
    cond = (F.col("kdcode") == F.col("_k")) & F.col("dt").between(F.col("valid_from"), F.col("valid_to"))
    if dedupe:
        return df.join(u, cond, "left_semi")
    return df.join(u, cond).drop("_k", "valid_from", "valid_to")


def impute(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """C10. Missing features take the mean of their date, then 0."""
    means = attach(df, ["dt"], **{f"_m_{c}": F.avg(c) for c in features})
    filled = [
        F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns
    ]
    return means.select(*filled)


def join_series(df: DataFrame, series: DataFrame) -> DataFrame:
    """C11. Market-wide columns by exact date; more than one row for a date is an error."""
    return join_series_dates(df, series)


def asof_dates(df: DataFrame, series: DataFrame) -> DataFrame:
    """C12. Market-wide columns of the last series row on or before each date.

    Only the distinct dates are matched (one row per date); the panel then joins by equality.
    """
    cols = [c for c in series.columns if c != "dt"]
    w = Window.partitionBy(F.lit(0)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    both = calendar(df).join(series.withColumn("_v", F.struct(*cols)).select("dt", "_v"), "dt", "full_outer")
    matched = both.select("dt", F.last("_v", ignorenulls=True).over(w).alias("_v"))
    return join_dates(df, matched).select(*df.columns, *[F.col(f"_v.{c}").alias(c) for c in cols])


def asof_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("kdcode",)) -> DataFrame:
    """C12. Per-key backward as-of join of two large tables: one shuffle by key, no range join.

    Both sides have at most one row per key and date, which bounds the window's partitions.
    """
    cols = [c for c in right.columns if c not in (*keys, "dt")]
    kind = F.struct(*[F.col(c) for c in cols])
    rest = [c for c in left.columns if c not in (*keys, "dt")]
    r = right.select(*keys, "dt", F.lit(0).alias("_side"), kind.alias("_v"))
    l = left.select(*keys, "dt", F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_x"), *rest).alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("dt", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*keys, "dt", *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_v.{c}").alias(c) for c in cols])


def densify(df: DataFrame, values: Sequence[str], fill: float = 0.0) -> DataFrame:
    """C13. One row per entity and calendar date, missing values filled.

    The grid is the result asked for; it is made by exploding the calendar (one small array) per
    entity, without a cross join.
    """
    dates = calendar(df).agg(F.sort_array(F.collect_list("dt")).alias("d")).scalar()
    grid = df.select("kdcode").distinct().select("kdcode", F.explode(dates).alias("dt"))
    full = grid.join(df.select("kdcode", "dt", *values), ["kdcode", "dt"], "left")
    return full.select("kdcode", "dt", *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in values])


def resolve_duplicates(df: DataFrame, order: str, keep: str = "last") -> DataFrame:
    """C14. One row per (kdcode, dt) by ingest order."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    return keep_last(df, ["kdcode", "dt"], order, first=keep == "first")


def quality_report(df: DataFrame, expected_entities: int, new_dates_after: str) -> DataFrame:
    """C15. (check_name, value, threshold, passed) for new dates, entity count and latest-day NULLs."""
    latest = df.agg(F.max("dt").alias("m")).scalar()
    nulls = df.where(F.col("dt") == latest).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in OHLCV])
    counts = df.groupBy("kdcode").agg(F.max("dt").alias("last_dt")).agg(F.count("*").cast("double").alias("entities"))
    fresh = calendar(df).agg(F.count_if(F.col("dt") > day(new_dates_after)).cast("double").alias("n")).scalar()
    c = nulls.withColumn("entities", counts.scalar()).withColumn("new_dates", fresh)
    checks = [
        F.struct(
            F.lit("new_dates").alias("check_name"), F.col("new_dates").alias("value"), F.lit(1.0).alias("threshold"),
            (F.col("new_dates") >= 1).alias("passed"),
        ),
        F.struct(
            F.lit("entities").alias("check_name"), F.col("entities").alias("value"),
            F.lit(expected_entities * 0.8).alias("threshold"), (F.col("entities") >= expected_entities * 0.8).alias("passed"),
        ),
    ] + [
        F.struct(
            F.lit(f"null_{k}").alias("check_name"), F.col(k).alias("value"), F.lit(0.05).alias("threshold"),
            (F.col(k) <= 0.05).alias("passed"),
        )
        for k in OHLCV
    ]
    return c.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def coverage(requested: DataFrame, fetched: DataFrame, minimum: float = 0.8) -> DataFrame:
    """C16. Share of requested entities that were fetched."""
    have = fetched.select("kdcode").distinct().withColumn("_hit", F.lit(1))
    return (
        requested.select("kdcode").distinct().join(have, "kdcode", "left")
        .agg(F.count("*").alias("requested"), F.count("_hit").alias("fetched"))
        .withColumn("coverage", F.try_divide(F.col("fetched").cast("double"), F.col("requested").cast("double")))
        .withColumn("passed", F.coalesce(F.col("coverage") >= minimum, F.lit(False)))
    )


def missing_entities(requested: DataFrame, fetched: DataFrame) -> DataFrame:
    """C16. Requested entities that were not fetched."""
    return requested.select("kdcode").distinct().join(fetched.select("kdcode").distinct(), "kdcode", "left_anti")


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """C17. The last ``n`` trading dates."""
    return calendar(df).orderBy(F.desc("dt")).limit(n)


def previous_dates(df: DataFrame) -> DataFrame:
    """C17. Every trading date with the one before."""
    w = Window.partitionBy(F.lit(0)).orderBy("dt")
    return calendar(df).withColumn("prev_dt", F.lag("dt").over(w))


def dates_after(df: DataFrame, after: str) -> DataFrame:
    """C17. Trading dates after a date."""
    return calendar(df).where(F.col("dt") > day(after))


def largest_at(df: DataFrame, shares: DataFrame, target: str, n: int, window_days: int = 7) -> DataFrame:
    """C18. The ``n`` largest entities by price x shares at a date.

    The price is the last close on or before the date within the window, else the first after it.
    """
    near = df.where(
        F.col("dt").between(F.date_sub(day(target), window_days), F.date_add(day(target), window_days))
    )
    before, after = F.col("dt") <= day(target), F.col("dt") > day(target)
    price = near.groupBy("kdcode").agg(
        F.coalesce(
            F.max_by(F.when(before, F.col("close")), F.when(before, F.col("dt"))),
            F.min_by(F.when(after, F.col("close")), F.when(after, F.col("dt"))),
        ).alias("price")
    )
    sized = price.join(shares.where(F.col("shares") > 0), "kdcode").withColumn("size", F.col("price") * F.col("shares"))
    return sized.orderBy(F.desc("size"), "kdcode").limit(n)


def keep_members(df: DataFrame, members: DataFrame, on: str = "kdcode") -> DataFrame:
    """C19. Rows whose key is in a set."""
    return df.join(members.select(on), on, "left_semi")
