"""Evaluation of ranking scores.

Inputs are pairs (model_id, dt, kdcode, score, ret). Per-date statistics are aggregates with partial
sums per task; ranks over whole cross-sections are range partitioned; only the best K of a date
reach a window. What is left has one row per model and date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.ranking import pivoted_ranks, running_total, value_ranks
from rankloom.operators.portfolio import best_scores
from rankloom.session import stable

YEAR = 252
EPS = 1e-8


def ensemble_mean(scores: DataFrame, digits: int = 5) -> DataFrame:
    """V1. Mean score over the models."""
    return scores.groupBy("dt", "kdcode").agg(F.round(F.avg("score"), digits).alias("score"))


def error_metrics(pairs: DataFrame, by: Sequence[str] = ("model_id",), pred: str = "score", actual: str = "ret") -> DataFrame:
    """V2. MSE, RMSE and MAE over rows where both sides are present."""
    d = F.col(pred) - F.col(actual)
    return pairs.groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(d).alias("n_pairs")
    )


def _ic(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*by)
        .agg(F.count("*").alias("_n"), F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"), F.covar_pop(a, b).alias("_c"))
        .where("_n >= 2 AND _sa > 0 AND _sb > 0")
        .select(*by, (F.col("_c") / (F.col("_sa") * F.col("_sb"))).alias("ic"))
    )


def daily_ic(pairs: DataFrame, by: Sequence[str] = ("model_id", "dt")) -> DataFrame:
    """V3. Pearson correlation of score and return per date; constant sides drop out."""
    return _ic(pairs, by, "score", "ret")


def daily_rank_ic(pairs: DataFrame, by: Sequence[str] = ("model_id", "dt")) -> DataFrame:
    """V4. Spearman correlation: Pearson on average ranks of the valid pairs, one row per entity and group."""
    valid = pairs.where(F.col("score").isNotNull() & F.col("ret").isNotNull())
    sides = ["score", "ret"]
    ranks = pivoted_ranks(valid, by, sides, value_ranks(valid, by, sides), ["kdcode"], {"avg_rank": "rank"})
    return _ic(ranks, by, "score_rank", "ret_rank")


def ic_summary(ic: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """V5. Mean, median and ratio of a daily series."""
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("avg_ic"),
        F.percentile("ic", 0.5).alias("median_ic"),
        (F.avg("ic") / (F.stddev_pop("ic") + EPS)).alias("ic_ir"),
    )


def top_k_daily(pairs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """V6, B16. (model_id, k, dt, r): mean return of the K best scores, every K in one pass."""
    best = best_scores(pairs, max(ks))
    sizes = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    return (
        best.select("model_id", "dt", "ret", F.explode(sizes).alias("k"))
        .groupBy("model_id", "k", "dt")
        .agg(F.avg("ret").alias("r"))
        .where(F.col("r").isNotNull())
    )


def portfolio_metrics(daily: DataFrame, by: Sequence[str] = ("model_id", "k")) -> DataFrame:
    """V7. Mean, sum and naive Sharpe of daily returns."""
    return daily.groupBy(*by).agg(
        F.avg("r").alias("avg_return"),
        F.sum("r").alias("cumulative_return"),
        (F.avg("r") / (F.stddev_pop("r") + EPS) * YEAR**0.5).alias("sharpe_naive"),
    )


def newey_west(daily: DataFrame, lags: int, by: Sequence[str] = ("model_id", "k"), order: str = "dt", value: str = "r") -> DataFrame:
    """V8. Autocorrelation-robust deviation and Sharpe with Bartlett weights, L = min(lags, n - 1)."""
    if lags < 0:
        raise ValueError("lags must not be negative")
    d = daily.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("_x"))
    means = d.groupBy(*by).agg(F.avg("_x").alias("_m"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(order)  # one row per date
    c = d.join(means, list(by)).withColumn("_c", F.col("_x") - F.col("_m"))
    c = c.select("*", *[(F.col("_c") * F.lag("_c", l).over(w)).alias(f"_p{l}") for l in range(1, lags + 1)])
    sums = c.groupBy(*by).agg(
        F.max("_m").alias("_m"),
        F.max("_n").alias("_n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_p0"),
        *[F.sum(f"_p{l}").alias(f"_p{l}") for l in range(1, lags + 1)],
    )
    limit = F.least(F.lit(lags), F.col("_n") - 1)
    var = F.col("_p0") / F.col("_n")
    for l in range(1, lags + 1):
        part = 2 * (1 - F.lit(l) / (limit + 1.0)) * F.coalesce(F.col(f"_p{l}"), F.lit(0.0)) / F.col("_n")
        var = var + F.when(F.lit(l) <= limit, part).otherwise(0.0)
    std = F.when(F.col("_n") <= 1, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    sharpe = F.when(std > 0, F.col("_m") / std * YEAR**0.5).otherwise(0.0)
    return sums.select(*by, std.alias("nw_std"), sharpe.alias("sharpe_newey_west"))


# Multipliers and modulus of the block-start hash.
HASH_MOD, HASH_A, HASH_B = 2147483647, 48271, 69621


def block_start(seed: int, replicate: Column, block: Column, n: Column) -> Column:
    """Start of a bootstrap block: a whole-number hash of (seed, replicate, block), modulo n."""
    x = (F.lit(seed).cast("bigint") * 1000003 + replicate * 7919 + block * 104729) % HASH_MOD
    x = x * HASH_A % HASH_MOD
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = x * HASH_B % HASH_MOD
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x % n


def bootstrap(
    daily: DataFrame,
    block_size: int,
    n_resamples: int,
    seed: int,
    ci_level: float = 0.95,
    statistic: Column | str = "mean",
    by: Sequence[str] = ("model_id", "k"),
    order: str = "dt",
    value: str = "r",
) -> DataFrame:
    """V9, U2. Circular moving-block bootstrap interval of a statistic per key.

    ``statistic`` is mean, sum, std, sharpe or any aggregate Column over ``x``. A replicate is a set
    of (block, offset) rows joined to the series by position and aggregated with partial sums, so
    replicates and keys run in parallel.
    """
    if block_size <= 0 or n_resamples <= 0 or not 0 < ci_level < 1:
        raise ValueError("block_size and n_resamples must be positive, ci_level in (0, 1)")
    named = {
        "mean": F.avg("x"),
        "sum": F.sum("x"),
        "std": F.stddev_pop("x"),
        "sharpe": F.avg("x") / (F.stddev_pop("x") + EPS) * YEAR**0.5,
    }
    stat = named[statistic] if isinstance(statistic, str) else statistic
    w = Window.partitionBy(*by).orderBy(order)  # one row per date
    series = daily.where(F.col(value).isNotNull()).select(
        *by, F.col(value).alias("x"), (F.row_number().over(w) - 1).cast("bigint").alias("pos")
    )
    sizes = series.groupBy(*by).agg(F.count("*").alias("n"))
    blocks = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("replicate")).select(
        *by, "n", "replicate",
        F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block_size) - 1).cast("int"))).alias("block"),
    )
    drawn = (
        blocks.withColumn("start", block_start(seed, F.col("replicate"), F.col("block"), F.col("n")))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(block_size - 1))).alias("off"))
        .where(F.col("block") * block_size + F.col("off") < F.col("n"))
        .select(*by, "replicate", ((F.col("start") + F.col("off")) % F.col("n")).alias("pos"))
    )
    stats = drawn.join(series, [*by, "pos"]).groupBy(*by, "replicate").agg(stat.alias("s"))
    alpha = 1 - ci_level
    return stats.groupBy(*by).agg(
        F.percentile("s", alpha / 2).alias("ci_lower"), F.percentile("s", 1 - alpha / 2).alias("ci_upper")
    )


def hit_rate(pairs: DataFrame, threshold: float = 0.0, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """V10. Share of rows whose score side matches the sign of the return."""
    hit = (F.col("score") > threshold) == (F.col("ret") > 0)
    return pairs.groupBy(*by).agg(F.avg(hit.cast("double")).alias("hit_rate"))


def quantile_days(pairs: DataFrame, quantiles: int = 5) -> DataFrame:
    """V11. (model_id, dt, quantile 1..q, r): bucket = rank // (n // q), the last takes the rest; mean return of each."""
    keys = ["model_id", "dt"]
    ranked = running_total(pairs, keys, ["score", "kdcode"], F.lit(1).cast("bigint"), "rank", total="n")
    size = F.floor(F.col("n") / quantiles)
    bucket = F.when(size > 0, F.least(F.floor((F.col("rank") - 1) / size), F.lit(quantiles - 1))).otherwise(quantiles - 1)
    return ranked.groupBy(*keys, (bucket + 1).cast("int").alias("quantile")).agg(F.avg("ret").alias("r"))


def quantile_returns(pairs: DataFrame, quantiles: int = 5) -> DataFrame:
    """V11. (model_id, quantile, mean_return): mean over the dates."""
    return quantile_days(pairs, quantiles).groupBy("model_id", "quantile").agg(F.avg("r").alias("mean_return"))


def long_short(quantile: DataFrame, quantiles: int = 5) -> DataFrame:
    """V11. Top minus bottom quantile."""
    q = F.col("quantile")
    top, low = (F.max(F.when(q == n, F.col("mean_return"))) for n in (quantiles, 1))
    return quantile.groupBy("model_id").agg((top - low).alias("long_short_spread"))


def day_moments(pairs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(model_id, dt): sums of errors and hits with their counts, and ``ic``, in one pass with partial sums."""
    d = F.col("score") - F.col("ret")
    hit = ((F.col("score") > threshold) == (F.col("ret") > 0)).cast("double")
    both = lambda c: F.when(d.isNotNull(), F.col(c))
    sums = pairs.groupBy("model_id", "dt").agg(
        F.count(d).alias("n"), F.sum(d * d).alias("squares"), F.sum(F.abs(d)).alias("absolutes"), F.sum(hit).alias("hits"),
        F.stddev_pop(both("score")).alias("_sa"), F.stddev_pop(both("ret")).alias("_sb"), F.covar_pop("score", "ret").alias("_c"),
    )
    spread = (F.col("n") >= 2) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return sums.withColumn("ic", F.when(spread, F.col("_c") / (F.col("_sa") * F.col("_sb")))).drop("_sa", "_sb", "_c")


def evaluation_row(pairs: DataFrame, ks: Sequence[int], label_t: int = 1, quantiles: int = 5, nw_lags: int | None = None) -> DataFrame:
    """V12. One wide row per model with the metrics of V2 to V11.

    What each pass finds about a date is a row of small tables, which are stacked and summed up by model once. The pairs
    are read for the moments, the ranks, the buckets and the best.
    """
    lags = max(0, label_t - 1) if nw_lags is None else nw_lags
    pairs = stable(pairs.select("model_id", "dt", "kdcode", "score", "ret"))
    daily = top_k_daily(pairs, ks)
    sharpe = "sharpe_newey_west" if label_t > 1 else "sharpe_naive"
    per_k = portfolio_metrics(daily).join(newey_west(daily, lags), ["model_id", "k"]).withColumn("sharpe", F.col(sharpe))
    names = {
        "avg_return": "return_top_{k}", "sharpe": "sharpe_top_{k}", "sharpe_naive": "sharpe_top_{k}_naive",
        "sharpe_newey_west": "sharpe_top_{k}_newey_west",
    }
    found = day_moments(pairs)
    spearman = daily_rank_ic(pairs).select("model_id", "dt", F.col("ic").alias("rank_ic"))
    for part in (spearman, quantile_days(pairs, quantiles), per_k.select("model_id", "k", *names)):
        found = found.unionByName(part, allowMissingColumns=True)

    def at(key: str, value: int, c: str) -> Column:
        return F.avg(F.when(F.col(key) == value, F.col(c)))

    mse = F.try_divide(F.sum("squares"), F.sum("n"))
    out = found.groupBy("model_id").agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.try_divide(F.sum("absolutes"), F.sum("n")).alias("mae"),
        F.avg("ic").alias("avg_ic"), F.percentile("ic", 0.5).alias("median_ic"), (F.avg("ic") / (F.stddev_pop("ic") + EPS)).alias("ic_ir"),
        F.avg("rank_ic").alias("avg_spearman_corr"), F.try_divide(F.sum("hits"), F.sum("n")).alias("hit_rate"),
        *[at("quantile", q, "r").alias(f"quantile_{q}_return") for q in range(1, quantiles + 1)],
        *[at("k", k, c).alias(n.format(k=k)) for k in ks for c, n in names.items()],
    )
    return out.withColumn("long_short_spread", F.col(f"quantile_{quantiles}_return") - F.col("quantile_1_return"))


def ic_losses(pairs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """V13. Negative mean IC and its blend with the squared error, eps added to both norms."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    n = F.col("n")
    day = pairs.groupBy("model_id", "dt").agg(
        F.count("*").alias("n"), F.covar_pop("score", "ret").alias("c"),
        F.stddev_pop("score").alias("sa"), F.stddev_pop("ret").alias("sb"),
    )
    norm_a, norm_b = F.sqrt(n) * F.col("sa") + EPS, F.sqrt(n) * F.col("sb") + EPS
    ic = day.groupBy("model_id").agg(F.avg(n * F.col("c") / (norm_a * norm_b)).alias("mean_ic"))
    out = ic.join(error_metrics(pairs).select("model_id", "mse"), "model_id")
    return out.select(
        "model_id",
        "mse",
        (-F.col("mean_ic")).alias("ic_loss"),
        ((1 - alpha) * F.col("mse") - alpha * F.col("mean_ic")).alias("combined_loss"),
    )


def compare_scores(new: DataFrame, old: DataFrame, tolerance: float = 1e-4, by: Sequence[str] = ()) -> DataFrame:
    """V14. Largest and mean score difference per date of two prediction sets, for each value of ``by`` in both."""
    keys = [*by, "dt", "kdcode"]
    both = new.select(*keys, F.col("score").alias("a")).join(old.select(*keys, F.col("score").alias("b")), keys)
    d = F.abs(F.col("a") - F.col("b"))
    return both.groupBy(*by, "dt").agg(
        F.count("*").alias("n_compared"), F.max(d).alias("max_diff"), F.avg(d).alias("avg_diff")
    ).withColumn("matched", F.col("max_diff") < tolerance)


def average_metrics(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """V15. Mean of numeric metrics over the models of a group."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_models"))
