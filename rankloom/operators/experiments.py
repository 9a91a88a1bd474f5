"""Analytics over experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.groups import one_row

# Weights of the decision scores.
EVALUATION_WEIGHTS = {"avg_ic": 0.35, "avg_spearman_corr": 0.25, "sharpe_newey_west": 0.25, "return_top": 0.15}
BACKTEST_WEIGHTS = {"ASR": 0.35, "excess_return": 0.30, "MDD": -0.20, "avg_daily_turnover": -0.15}


def dotted(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a nested schema; arrays stay whole."""
    out: list[str] = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += dotted(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """X1. Nested structs to one column per leaf, named by its dotted path."""
    return df.select(*[F.col(p).alias(p) for p in dotted(df.schema)])


def read_runs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """X1. JSON run summaries, flattened; give a schema to skip the inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return flatten(reader.json(path))


def add_decision_score(runs: DataFrame, weights: dict[str, float], out: str = "decision_score") -> DataFrame:
    """X2. Weighted sum of z-scores over the runs; a missing value or constant metric adds 0."""
    used = [c for c in weights if c in runs.columns]
    s = one_row(runs.agg(*[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_samp(c).alias(f"s_{c}") for c in used]))
    d = runs.withColumn("_s", s)
    total = F.lit(0.0)
    for c in used:
        dev = F.col(f"_s.s_{c}")
        z = F.when(dev > 0, (F.col(c) - F.col(f"_s.m_{c}")) / dev)
        total = total + weights[c] * F.coalesce(z, F.lit(0.0))
    return d.withColumn(out, total).drop("_s")


def add_recommendation(runs: DataFrame, ic_lower: str, return_lower: str, status: str = "status") -> DataFrame:
    """X3. CI gates and recommendation."""
    ic, ret = (F.coalesce(F.col(c) > 0, F.lit(False)) for c in (ic_lower, return_lower))
    both = ic & ret
    rec = (
        F.when(~F.col(status).eqNullSafe("OK"), "FAILED").when(both, "CONTINUE").when(ic | ret, "BORDERLINE").otherwise("STOP")
    )
    return runs.select(
        "*", ic.alias("ic_ci_pass"), ret.alias("top_ci_pass"), both.alias("both_ci_pass"), rec.alias("recommendation")
    )


def main_effects(runs: DataFrame, factors: Sequence[str], metric: str) -> DataFrame:
    """X4. Mean, median and count per level of each factor, all factors in one grouping-sets pass."""
    sets = [[F.col(f)] for f in factors]
    g = runs.groupingSets(sets, *[F.col(f) for f in factors]).agg(
        F.grouping_id().alias("_g"),
        F.avg(metric).alias("mean"),
        F.percentile(metric, 0.5).alias("median"),
        F.count(metric).alias("n_runs"),
    )
    # The only factor of a set is the one whose grouping bit is 0.
    last = len(factors) - 1
    level, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(factors):
        here = F.shiftright("_g", last - i).bitwiseAND(F.lit(1)) == 0
        level, name = F.when(here, F.col(f).cast("string")).otherwise(level), F.when(here, F.lit(f)).otherwise(name)
    return g.select(name.alias("factor"), level.alias("level"), "mean", "median", "n_runs")


def interaction(runs: DataFrame, left: str, right: str, levels: Sequence, metric: str) -> DataFrame:
    """X5. Mean of a metric for every pair of levels, ``right`` across."""
    return runs.groupBy(left).pivot(right, list(levels)).agg(F.avg(metric))
