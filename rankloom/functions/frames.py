"""Window frames over the rows of one entity.

(kdcode, dt) is unique in a panel, so a partition of these windows holds at most one row per
trading date: its size is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_entity(*keys: str, order: str = "dt") -> WindowSpec:
    return Window.partitionBy(*(keys or ("kdcode",))).orderBy(order)


def last_rows(w: WindowSpec, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return w.rowsBetween(-(rows - 1), 0)


def rows_before(w: WindowSpec, rows: int = 0) -> WindowSpec:
    """Rows strictly before the current one: the last ``rows``, or all for 0."""
    return w.rowsBetween(-rows if rows > 0 else Window.unboundedPreceding, -1)


def rows_so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rows_after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(0, Window.unboundedFollowing)


def gated(agg: Column, counted: Column, frame: WindowSpec, min_rows: int) -> Column:
    """``agg`` over ``frame``, NULL while the frame has fewer than ``min_rows`` values."""
    return F.when(F.count(counted).over(frame) >= min_rows, agg.over(frame))


def fill_forward(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(rows_so_far(w))


def fill_both(c: Column, w: WindowSpec) -> Column:
    """Forward fill, then backward fill of the leading gap."""
    return F.coalesce(fill_forward(c, w), F.first(c, ignorenulls=True).over(rows_after(w)))
