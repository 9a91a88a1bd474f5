"""Query registry and shared fragments of the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """SQL for a rounded double that never shows as minus zero."""
    return f"(CASE WHEN round(({expr})::DOUBLE, {digits}) = 0 THEN 0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END)"


SHARED: dict[str, tuple[str, str]] = {}


def share(name: str, body: str, needs: str = "") -> None:
    SHARED[name] = (needs, body)


def check_sql(needs: str, body: str) -> str:
    """The body with the shared fragments it needs put in front as CTEs."""
    done: list[str] = []

    def visit(n: str) -> None:
        deps, _ = SHARED[n]
        for d in deps.split():
            visit(d)
        if n not in done:
            done.append(n)

    for n in needs.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS ({SHARED[n][1]})" for n in done)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the given columns; minus zero becomes zero."""
    out = []
    for c in df.columns:
        if c in cols:
            v = F.round(c, digits)
            out.append(F.when(v == 0, F.lit(0.0)).otherwise(v).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def sig(expr: str) -> str:
    """SQL for a double kept to 7 significant digits (for values of any size)."""
    return f"(CASE WHEN ({expr}) = 0 THEN 0::DOUBLE ELSE printf('%.6e', ({expr})::DOUBLE)::DOUBLE END)"


def significant(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(
        *[
            F.when(F.col(c) == 0, 0.0).otherwise(F.format_string("%.6e", F.col(c)).cast("double")).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )
