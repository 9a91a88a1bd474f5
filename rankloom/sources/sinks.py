"""Writers: score tables, features and the back-test output set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scores(scores: DataFrame, path: str, digits: int = 5, fmt: str = "csv") -> str:
    """S14. One folder per model and date with rounded scores.

    Rows are rebalanced by model and date: small dates share a task, a large one is split by its size.
    """
    out = scores.select("model_id", "dt", "kdcode", F.round("score", digits).alias("score")).hint("rebalance", "model_id", "dt")
    # The file keeps its own date; the folder is named by a copy.
    out = out.select("model_id", F.col("dt").alias("date"), "kdcode", "dt", "score")
    writer = out.write.mode("overwrite").partitionBy("model_id", "date").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def write_features(features: DataFrame, path: str, digits: int = 6) -> str:
    """S14. Normalised features of each date, rounded."""
    cols = [c for c in features.columns if c not in ("kdcode", "dt")]
    out = features.select("dt", "kdcode", *[F.round(c, digits).alias(c) for c in cols])
    out.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(path)
    return path


def write_backtest(tables: dict[str, DataFrame], path: str) -> str:
    """S15. The output set of a back-test, one sub-folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def output_cells(spark: SparkSession, path: str, cells: dict[str, tuple[str, str | None, list[str]]]) -> DataFrame:
    """(table_name, strategy_id, dt, kdcode, item, value): what written tables hold, read back cell by cell. For each table
    its date column, its name column if it has one, and the columns to give."""
    out = None
    for name, (date, code, columns) in cells.items():
        at = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns])
        who = F.col(code).cast("string") if code else F.lit(None).cast("string")
        rows = spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("table_name"), "strategy_id", F.col(date).alias("dt"), who.alias("kdcode"), F.explode(at).alias("c"))
        rows = rows.select("table_name", "strategy_id", "dt", "kdcode", "c.item", "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def output_listing(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of every written table, read back."""
    counts = [
        spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n in names
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
