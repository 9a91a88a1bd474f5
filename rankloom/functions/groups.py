"""Group aggregates, keep-first/last and calendar helpers that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates as columns: aggregate (partial sums per task) and join back.

    Unlike a window over the group this never sends a whole cross-section to one task.
    """
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_dates(df, stats) if list(by) == ["dt"] else df.join(stats, list(by), "left")


def join_dates(df: DataFrame, per_date: DataFrame) -> DataFrame:
    """Left join of a table with one row per date.

    Its size is bounded by the calendar (366 rows a year) whatever the number of entities, so it is
    broadcast and the panel is not shuffled by date.
    """
    return df.join(F.broadcast(per_date), "dt", "left")


def join_series_dates(df: DataFrame, series: DataFrame) -> DataFrame:
    """Left join of a caller's table by date, which must have one row per date; Spark chooses by its size how."""
    once = F.expr("IF(count(*) = 1, true, raise_error('more than one row for a date'))").alias("_once")
    checked = series.groupBy("dt").agg(*[F.first(c).alias(c) for c in series.columns if c != "dt"], once)
    return df.join(checked.where("_once").drop("_once"), "dt", "left")


def lookup(small: DataFrame, large: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a small table to a large one without shuffling the large one.

    The large side is first reduced to the keys asked for by a semi join. Spark broadcasts those keys
    when their size allows it and shuffles otherwise; give a written table as ``small`` so that the
    size is known.
    """
    keys = small.select(*on).distinct()
    return small.join(large.join(keys, list(on), "left_semi"), list(on), "left")


def one_row(stats: DataFrame) -> Column:
    """The columns of a one-row aggregate as a struct, usable in any expression."""
    return stats.select(F.struct(*stats.columns)).scalar()


def keep_last(df: DataFrame, keys: Sequence[str], order: str, first: bool = False) -> DataFrame:
    """One row per key: the one with the largest (smallest) ``order`` value."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def calendar(df: DataFrame, date: str = "dt") -> DataFrame:
    """The distinct dates of a table."""
    return df.select(date).distinct()


def day_numbers(dates: DataFrame, date: str = "dt", out: str = "day_no") -> DataFrame:
    """0-based number of each distinct date. One row per date, so one task can order them."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(date)
    return dates.withColumn(out, F.row_number().over(w) - 1)
