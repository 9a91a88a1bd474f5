"""Panel sources: scan, index series, vendor reshapes, identifiers, appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.groups import keep_last
from rankloom.schema import OHLCV, PANEL, SCORES, clean_double, require_columns

# Vendor field names of each panel column, best first.
FIELD_NAMES = {
    "open": ("MKT_OPEN", "OPEN_PRC", "OPEN", "Open"),
    "high": ("MKT_HIGH", "HIGH_1", "HIGH", "High"),
    "low": ("MKT_LOW", "LOW_1", "LOW", "Low"),
    "close": ("TRDPRC_1", "HST_CLOSE", "CLOSE", "Close"),
    "volume": ("ACVOL_UNS", "VOLUME", "Volume"),
}


def scan_panel(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    fmt: str = "parquet",
    date: str = "dt",
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """S1. Read a panel with the date range and columns pushed to the scan."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(schema or PANEL)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    kind = df.schema[date].dataType
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast(kind))
    return df.select(*columns) if columns else df


def index_series(df: DataFrame, seq: str, start: str, end: str) -> DataFrame:
    """S2. One index as a panel: fill open/high/low from close and volume with 0, last row per date."""
    require_columns(df, ["dt", "close"])
    have = set(df.columns)
    filled = df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        F.lit("INDEX").alias("kdcode"),
        "dt",
        *[
            (F.coalesce(F.col(c), F.col("close")) if c in have else F.col("close")).alias(c)
            for c in ("open", "high", "low")
        ],
        "close",
        (F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in have else F.lit(0.0)).alias("volume"),
        seq,
    )
    return keep_last(filled, ["kdcode", "dt"], seq).drop(seq)


def reshape_wide(wide: DataFrame, sep: str = "|", seq: str = "seq") -> DataFrame:
    """S9. ``instrument|FIELD`` columns over dates to the long panel with turnover.

    Of several rows of one date, the first by the ingest column ``seq`` that has a close gives the whole bar. Every
    instrument's bar is one struct of the wide row, so rows are never mixed; one aggregation by (kdcode, dt) keeps the
    first. An instrument without any close column, or a frame without one of the price fields, is an error.
    """
    fields: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if c not in ("dt", seq):
            name, _, field = c.partition(sep)
            fields.setdefault(name, {})[field] = c
    seen = {field for of in fields.values() for field in of}
    missing = [c for c in OHLCV if not seen & set(FIELD_NAMES[c])]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")

    def bar(name: str, of: dict[str, str]) -> Column:
        pick = {c: [F.col(f"`{of[n]}`").cast("double") for n in names if n in of] for c, names in FIELD_NAMES.items()}
        values = [(F.coalesce(*v) if v else F.lit(None).cast("double")).alias(c) for c, v in pick.items()]
        return F.struct(F.lit(name).alias("kdcode"), *values)

    bars = wide.select("dt", seq, F.explode(F.array(*[bar(n, of) for n, of in fields.items()])).alias("bar"))
    first = bars.where(F.col("bar.close").isNotNull()).groupBy(F.col("bar.kdcode").alias("kdcode"), "dt").agg(F.min_by("bar", seq).alias("bar"))
    return first.select("kdcode", "dt", *[f"bar.{c}" for c in FIELD_NAMES]).withColumn("turnover", F.col("volume") * F.col("close"))


def reshape_flat(df: DataFrame, instrument: str, seq: str) -> DataFrame:
    """S10. One instrument's flat vendor frame to the panel; first row per date is kept."""
    renamed = df.select(
        F.lit(instrument).alias("kdcode"),
        "dt",
        seq,
        *[
            F.coalesce(*[clean_double(F.col(f"`{n}`")) for n in names if n in df.columns]).alias(c)
            if any(n in df.columns for n in names)
            else F.lit(None).cast("double").alias(c)
            for c, names in FIELD_NAMES.items()
        ],
    )
    kept = renamed.dropna(how="all", subset=list(OHLCV)).dropna(subset=["close"])
    return keep_last(kept, ["kdcode", "dt"], seq, first=True).drop(seq)


def strip_exchange(code: Column) -> Column:
    """S11. Drop the exchange suffix after the last dot."""
    return F.regexp_replace(code, r"\.[^.]*$", "")


def yahoo_ticker(code: Column) -> Column:
    """S11. Trim and write share classes with a dash."""
    return F.replace(F.trim(code), F.lit("."), F.lit("-"))


def append_increment(base: DataFrame, new: DataFrame, start: str) -> DataFrame:
    """S12. Add new rows from ``start`` on; a later row of the same (kdcode, dt) wins."""
    both = base.withColumn("_batch", F.lit(0)).unionByName(
        new.where(F.col("dt") >= F.lit(start).cast("date")).withColumn("_batch", F.lit(1))
    )
    return keep_last(both, ["kdcode", "dt"], "_batch").drop("_batch")


def append_report(base: DataFrame, merged: DataFrame) -> DataFrame:
    """S12. Rows before, after and added."""
    tagged = base.select(F.lit("before").alias("side")).unionByName(merged.select(F.lit("after").alias("side")))
    return tagged.agg(
        F.count_if(F.col("side") == "before").alias("rows_before"),
        F.count_if(F.col("side") == "after").alias("rows_after"),
    ).withColumn("rows_added", F.col("rows_after") - F.col("rows_before"))


def load_scores(spark: SparkSession, folder: str) -> DataFrame:
    """S13. Every per-date score file below a folder of model folders; model_id is NULL outside of one."""
    df = (
        spark.read.schema(SCORES)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    model = F.regexp_extract(F.input_file_name(), r"model_id=([0-9]+)", 1).try_cast("int")
    return df.withColumn("model_id", model)


def fingerprint(df: DataFrame) -> DataFrame:
    """S16. Order-free fingerprint of a row set: sums of two parts of the rows' MD5, count and date range.

    A row is hashed as text with its columns marked and the length of each value before it, so that a NULL, its place,
    repeated rows and values that hold marks themselves all count.
    """
    cell = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit("'"), F.col(f"`{c}`").cast("string")), F.lit("NULL")), F.lit(";"))
    digest = F.md5(F.concat(*[cell(c) for c in df.columns]))
    part = lambda k: F.sum(F.conv(F.substring(digest, k, 12), 16, 10).cast("decimal(20,0)"))
    return df.agg(
        F.concat_ws(":", part(1).cast("string"), part(13).cast("string")).alias("row_hash"),
        F.count("*").alias("n_rows"),
        F.min("dt").alias("first_dt"),
        F.max("dt").alias("last_dt"),
    )
