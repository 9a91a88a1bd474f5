"""Exact ranks, running totals and quantiles over groups of any size.

A window over ``partitionBy(dt)`` puts a whole cross-section in one task. Here the rows are dealt by ranges of group and
value, so a slice holds about ``SLICE`` rows however large a group is. Each slice counts locally, and the small table of
slice totals gives every slice its offset. The slices are written with their numbers, as ranges come from a sample, and so
that the rows are computed once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import stable

SLICE = 1 << 20  # rows of a slice on average
# Spark limits rows before the shuffle for rank filters up to this many rows
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def in_order(order: Sequence[str]) -> list[Column]:
    """Sort columns of names; a minus before a name sorts it downwards, nulls last."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order]


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], measure: Column, out: str, total: str | None = None
) -> DataFrame:
    """``df`` with ``out`` = sum of ``measure`` over the rows of the group up to this row.

    (by, order) must identify a row; see ``in_order``. ``total`` names a column for the sum of the whole group, which
    the slice totals give for free.
    """
    held = stable(df.withColumn("_m", measure))
    slices = math.ceil(held.count() / SLICE)
    if slices > 1:
        sliced = stable(held.repartitionByRange(slices, *by, *in_order(order)).withColumn("_slice", F.spark_partition_id()))
    else:
        sliced = held.withColumn("_slice", F.lit(0))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(F.sum("_m").alias("_t"))
        .select(
            *by,
            "_slice",
            F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"),
            *([F.sum("_t").over(Window.partitionBy(*by)).alias(total)] if total else []),
        )
    )
    local = Window.partitionBy(*by, "_slice").orderBy(*in_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_upto", F.sum("_m").over(local))
        .join(offsets, [*by, "_slice"])
        .withColumn(out, F.col("_offset") + F.col("_upto"))
        .drop("_m", "_slice", "_offset", "_upto")
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """1-based position of every row of its group in ``order`` (which must have no ties)."""
    return running_total(df, by, order, F.lit(1).cast("bigint"), out)


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, measure, value): a row for each value of the columns that is not NULL."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("v")).select(*keys, "v.measure", "v.value").where(F.col("value").isNotNull())


def value_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, measure, value, avg_rank, n): the mean rank of each distinct value, and the group's count.

    Equal values are counted before anything is shuffled, so a value that fills a large part of a group costs one row
    per task.
    """
    key = [*by, "measure"]
    values = long_values(df, columns, by).groupBy(*key, "value").agg(F.count("*").alias("ties"))
    upto = running_total(values, key, ["value"], F.col("ties"), "upto", total="n")
    return upto.select(*key, "value", (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("avg_rank"), "n")


def pivoted_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], ranks: DataFrame, row: Sequence[str], names: dict[str, str]) -> DataFrame:
    """(by, row) with columns of ``ranks`` for each of ``columns``: ``names`` gives their endings.

    All columns are looked up by one join of (by, measure, value), and put side by side by row; ``row`` and ``by`` must
    identify a row. A value that many rows hold is split by the adaptive skew join.
    """
    keys = list(dict.fromkeys([*by, *row]))
    cells = long_values(df, columns, keys).join(ranks, [*by, "measure", "value"], "left")
    picked = [F.max(F.when(F.col("measure") == c, F.col(field))).alias(f"{c}_{end}") for c in columns for field, end in names.items()]
    return cells.groupBy(*keys).agg(*picked)


def average_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], row: Sequence[str] = ("kdcode", "dt")) -> DataFrame:
    """Add ``<c>_rank`` (ties share their mean rank) and ``<c>_n`` for each column; NULLs get NULL.

    With several columns, ``by`` and ``row`` must identify a row.
    """
    ranks = value_ranks(df, by, columns)
    if len(columns) > 1:
        keys = list(dict.fromkeys([*by, *row]))
        return df.join(pivoted_ranks(df, by, columns, ranks, row, {"avg_rank": "rank", "n": "n"}), keys, "left")
    c = columns[0]
    one = ranks.select(*by, F.col("value").alias("_value"), F.col("avg_rank").alias(f"{c}_rank"), F.col("n").alias(f"{c}_n"))
    return df.withColumn("_value", F.col(c).cast("double")).join(one, [*by, "_value"], "left").drop("_value")


def percent_ranks(df: DataFrame, by: Sequence[str], columns: Sequence[str], row: Sequence[str] = ("kdcode", "dt")) -> DataFrame:
    """Add ``<c>_pct``: mean rank of ties divided by the group's count."""
    out = average_ranks(df, by, columns, row)
    for c in columns:
        out = out.withColumn(f"{c}_pct", F.col(f"{c}_rank") / F.col(f"{c}_n"))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("rank", "n")])


def groups_fit(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether no group has more rows than a slice, so that a task may take whole groups."""
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= SLICE


def percent_ranks_of_groups(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As ``percent_ranks``, for groups that ``groups_fit``: a task sorts whole groups, so one shuffle of the rows serves all
    columns, and nothing is joined or written."""
    group = Window.partitionBy(*by)
    for c in columns:
        v = F.col(c).cast("double")
        order = group.orderBy(v.asc_nulls_last())
        upto = F.count(c).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        df = df.withColumn(f"{c}_pct", F.when(v.isNotNull(), (F.rank().over(order) + upto) / 2.0))
    return df.withColumns({f"{c}_pct": F.col(f"{c}_pct") / F.count(c).over(group) for c in columns})


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their position.

    The rank filter is pushed below the shuffle by Spark (WindowGroupLimit); beyond its threshold a
    salted first round does the same job.
    """
    if k > GROUP_LIMIT:
        salted = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
            .withColumn("_r", F.row_number().over(salted))
            .where(F.col("_r") <= k)
            .drop("_r", "_salt")
        )
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def quantile_brackets(values: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int) -> DataFrame:
    """(by, n, _lo0, _hi0, ...): for each probability an interval of values that holds its quantile, from one sketch.

    The sketch is within ``n / accuracy`` ranks; an interval reaches four times that, or to the least and largest value,
    as it does in groups of fewer than ``accuracy`` rows.
    """
    step = 4.0 / accuracy
    at = sorted({x for p in probs for x in (p - step, p + step) if 0 < x < 1})
    agg = values.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("_least"), F.max(value).alias("_most"),
        F.percentile_approx(value, at or [0.5], accuracy).alias("_q"),
    )

    def end(x: float, outer: str) -> Column:
        return F.when(F.col("n") >= accuracy, F.col("_q")[at.index(x)]).otherwise(F.col(outer)) if 0 < x < 1 else F.col(outer)

    lows = [end(p - step, "_least").alias(f"_lo{k}") for k, p in enumerate(probs)]
    return agg.select(*by, "n", *lows, *[end(p + step, "_most").alias(f"_hi{k}") for k, p in enumerate(probs)])


def exact_quantiles(values: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Linear-interpolation quantiles as (by, q_index, q), q_index 0-based in the sorted ``probs``; NULL values do not count.

    A sketch brackets each quantile. One pass then counts the values inside the brackets by value, about ``8 / accuracy``
    of all for each quantile, and all others by the gap that they are in, which is a row for each task and gap; so little
    is shuffled. Positions inside a bracket are exact. Should a bracket miss its position, which the sketch rules out,
    the query fails instead of giving a wrong value. ``values`` is read twice.
    """
    by, probs, v = list(by), sorted(probs), F.col(value)
    values = values.where(v.isNotNull())
    brackets = stable(quantile_brackets(values, by, value, probs, accuracy))  # its size is known, so the values stay where they are
    joined = values.join(brackets, by)
    ends = [(F.col(f"_lo{k}"), F.col(f"_hi{k}")) for k in range(len(probs))]
    inside = reduce(or_, [(v >= lo) & (v <= hi) for lo, hi in ends])
    gap = reduce(add, [(v >= lo).cast("int") for lo, _ in ends])
    counts = joined.groupBy(*by, "n", gap.alias("_gap"), F.when(inside, v).alias("_inside")).agg(F.max(v).alias("_v"), F.count("*").alias("_ties"))
    upto = running_total(stable(counts), by, ["_v"], F.col("_ties"), "_last")
    first = F.col("_last") - F.col("_ties")

    def at(place: Column) -> Column:
        found = F.max(F.when((first <= place) & (place < F.col("_last")), F.col("_inside")))
        return F.coalesce(found, F.raise_error(F.lit("a bracket misses its quantile")).cast("double"))

    def quantile(p: float) -> Column:
        lo = F.floor(p * (F.col("n") - 1))
        return F.struct(at(lo).alias("a"), at(F.ceil(p * (F.col("n") - 1))).alias("b"), (p * (F.first("n") - 1) - F.first(lo)).alias("part"))

    found = upto.groupBy(*by).agg(F.array(*[quantile(p) for p in probs]).alias("_q"))
    return found.select(*by, F.posexplode("_q").alias("q_index", "_e")).select(
        *by, "q_index", (F.col("_e.a") + (F.col("_e.b") - F.col("_e.a")) * F.col("_e.part")).alias("q")
    )
