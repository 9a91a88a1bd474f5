"""Incremental twins of the batch operators on Structured Streaming.

Each gives the rows of its batch twin on the same input; T1 and T4 emit a day once its window has
closed. T2, T5 and T6 keep their tables between batches in a ``versions.Store``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

from rankloom.functions.groups import keep_last
from rankloom.operators.clean import point_in_time
from rankloom.operators.drift import bin_counts as count_bins
from rankloom.operators.drift import bin_of, drift_of_counts, feature_values
from rankloom.operators.ledger import LOCAL, compose_ledger, month_ledger, month_summaries
from rankloom.operators.normalize import normalise
from rankloom.operators.portfolio import day_arrays, fold_gate, rank_scores
from rankloom.session import stable
from rankloom.streaming.versions import Store, months_in


def read_files(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run over all available input, write Parquet, return the written table."""
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True).start(f"{path}/table")
    )
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run ``each`` per micro-batch over all available input."""
    q = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """T1. Ticks (kdcode, ts, value, event_id) to daily bars; rows later than ``delay`` are dropped."""
    day = F.window("ts", "1 day")
    out = ticks.withWatermark("ts", delay).groupBy(day.alias("w"), "kdcode").agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.sum("value").alias("volume"),
    )
    return out.select("kdcode", F.to_date("w.start").alias("dt"), "open", "high", "low", "close", "volume")


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: str) -> bool:
    """T2. Merge a batch into a store by month of ``dt``: the highest ``order`` wins. Gives whether anything changed.

    Only touched months are read and written anew, and they become visible in one rename, so a run that dies half-way
    loses nothing and is simply repeated. A batch that changes nothing makes no version.
    """
    store = Store(batch.sparkSession, path)
    changed = merge(store, "panel", batch, keys, order)
    if changed:
        store.commit()
    return changed


def merge(store: Store, table: str, batch: DataFrame, keys: Sequence[str], order: str) -> bool:
    """Stage the touched months of a table with the rows of a batch merged in; whether any row is new."""
    months = months_in(batch)
    old = store.read(table, batch.schema, months)
    kept = keep_last(old.unionByName(batch), list(keys), order)
    if not months or kept.exceptAll(old).isEmpty():
        return False
    store.stage(table, kept, months)
    return True


def panel_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """T2. The panel as of now."""
    return Store(spark, path).read("panel", schema)


def append_panel(stream: DataFrame, path: str, keys: Sequence[str] = ("kdcode", "dt"), order: str = "seq") -> DataFrame:
    """T2. Idempotent panel append; returns the table."""
    run_batches(stream, path, lambda df, _: upsert(df, f"{path}/table", keys, order))
    return panel_of(stream.sparkSession, f"{path}/table", stream.schema)


def enrich(stream: DataFrame, universe: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """T3. Keep members at their date and scale with saved statistics: a stream-static join."""
    return normalise(point_in_time(stream, universe), features, stats)


def bin_counts(stream: DataFrame, reference: DataFrame, features: Sequence[str], delay: str = "1 day") -> DataFrame:
    """T4. (dt, feature, bin, n) of each closed day of a stream with ``ts``; bin -1 is out of range."""
    values = feature_values(stream.withWatermark("ts", delay), features, ["ts"])
    binned = values.join(reference.select("feature", "bins"), "feature").withColumn(
        "bin", F.coalesce(bin_of(F.col("value"), F.col("bins")), F.lit(-1))
    )
    out = binned.groupBy(F.window("ts", "1 day").alias("w"), "feature", "bin").agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("dt"), "feature", "bin", "n")


def drift_by_day(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """T4. Drift of every day in a table of bin counts."""
    rows = counts.groupBy("dt", "feature").agg(
        count_bins(F.col("bin"), F.col("n")).alias("observed"), F.sum("n").alias("observed_count")
    )
    return drift_of_counts(rows, reference, ["dt"])


# --- rank-drop gate --------------------------------------------------------------------------

def gate_batch(ranked: DataFrame, strategies: DataFrame, holdings: DataFrame | None, last_ranks: DataFrame | None) -> DataFrame:
    """T5. Decisions (strategy_id, dt, kdcode, status, rank) of the ranked days that follow known holdings and ranks.

    Only names that are held or once among the K best are kept, before they meet the strategies; give a written table, as
    it is read for the names and for their ranks. A name reaches the fold only from a day it is held or among the K best
    until it has left, so a strategy's group stays small.
    """
    limit = strategies.groupBy("model_id").agg(F.max("top_k").alias("max_k"))
    names = ranked.join(limit, "model_id").where("rank <= max_k").select("model_id", "kdcode")
    if holdings is not None:
        names = names.unionByName(holdings.join(strategies, "strategy_id").select("model_id", "kdcode"))
    names = stable(names.distinct())
    # Every date has a best name, so that no date is lost.
    today = stable(ranked.select("model_id", "dt", "kdcode", "rank").join(names, ["model_id", "kdcode"], "left_semi"))
    w = Window.partitionBy("model_id").orderBy("dt")
    days = today.select("model_id", "dt").distinct().withColumn("day_no", F.row_number().over(w))
    today = today.join(days, ["model_id", "dt"]).select("model_id", "dt", "kdcode", "rank", "day_no")
    if last_ranks is not None:
        before = last_ranks.join(names, ["model_id", "kdcode"], "left_semi")
        today = today.unionByName(before.select("model_id", "dt", "kdcode", "rank", F.lit(0).alias("day_no")))
    rows = today.join(strategies.select("strategy_id", "model_id", "top_k", "min_rank_drop"), "model_id")
    if holdings is not None:
        mark = holdings.select("strategy_id", "kdcode", F.lit(0).alias("day_no"), F.lit(True).alias("held"))
        rows = rows.join(mark, ["strategy_id", "kdcode", "day_no"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    else:
        rows = rows.withColumn("held", F.lit(False))
    name = Window.partitionBy("strategy_id", "kdcode").orderBy("day_no")
    follows = F.lag("day_no").over(name) == F.col("day_no") - 1
    rows = rows.withColumn("prev_rank", F.when(follows, F.lag("rank").over(name)))
    broke = ~follows | (F.col("rank") - F.col("prev_rank") >= F.col("min_rank_drop"))
    rows = rows.withColumn("_broke", F.coalesce(broke, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_broke").over(name.rowsBetween(Window.unboundedPreceding, 0)))
    enters = F.when(F.col("day_no") == 0, F.col("held")).otherwise(F.col("rank") <= F.col("top_k"))
    run = Window.partitionBy("strategy_id", "kdcode", "_run").orderBy("day_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_live", F.max(enters).over(run))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_live").over(name), F.lit(False))).where("_live OR _was")
    flags = {"daily": F.lit(False), "restart": F.lit(False), "realises": F.lit(True), "seq": F.struct("day_no", "dt")}
    arrays = day_arrays(rows.where("day_no > 0").withColumns(flags), ["strategy_id"])
    code = ranked.schema["kdcode"].dataType.simpleString()
    start = None
    if holdings is not None:
        kept = holdings.groupBy("strategy_id").agg(F.sort_array(F.collect_set("kdcode")).alias("start"))
        arrays = arrays.join(kept, "strategy_id", "left").withColumn("start", F.coalesce("start", F.expr(f"CAST(array() AS array<{code}>)")))
        start = F.col("start")
    return (
        arrays.select("strategy_id", F.explode(fold_gate(F.col("days"), code, "struct<day_no:int,dt:date>", start)).alias("d"))
        .select("strategy_id", "d.seq.dt", F.explode("d.names").alias("n"))
        .select("strategy_id", "dt", "n.kdcode", "n.status", "n.rank")
    )


def _decision_schema(strategies: DataFrame, scores: StructType) -> StructType:
    fields = {"strategy_id": strategies.schema["strategy_id"].dataType, "dt": DateType(), "kdcode": scores["kdcode"].dataType, "status": StringType(), "rank": LongType()}
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def merged_scores(old: DataFrame, new: DataFrame, batch_id: int) -> DataFrame:
    """T5. (model_id, dt, kdcode, score, batch_no, fresh): stored scores and those of a batch, the latest batch wins; fresh
    where this batch gives or changes the score. One aggregate of plain numbers, so a row is shuffled once."""
    keys = ["model_id", "dt", "kdcode"]
    known = old.select(*keys, F.col("score").alias("was"), F.col("batch_no").alias("was_no"))
    both = known.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("was", "was_no", "score")])
    taken = F.col("score").isNotNull() & (F.col("was_no").isNull() | (F.col("was_no") <= batch_id))
    return both.select(
        *keys,
        F.when(taken, F.col("score")).otherwise(F.col("was")).alias("score"),
        F.when(taken, F.lit(batch_id)).otherwise(F.col("was_no")).cast("long").alias("batch_no"),
        (taken & ~F.col("score").eqNullSafe(F.col("was"))).alias("fresh"),
    )


def update_gate(batch: DataFrame, strategies: DataFrame, path: str, batch_id: int) -> bool:
    """T5. Take in the scores of one batch and decide again from the earliest date of each model that they change.

    Dates may be split over batches, late, or given again: the score of the latest batch counts. A model is decided anew
    from its earliest date with a score that is new or differs; its holdings and ranks of the date before are the state
    to start from. Later decisions are replaced, earlier ones are not read. Scores of models that no strategy follows are
    stored, but need no ranks. Scores, dates and decisions become visible in one version, so a batch that dies half-way
    is repeated from the state before it. Rows without model, date, name or score are left out. Gives whether anything
    changed.
    """
    spark, store = batch.sparkSession, Store(batch.sparkSession, f"{path}/gate")
    new = stable(batch.select("model_id", "dt", "kdcode", "score").dropna())
    months = months_in(new)
    if not months:
        return False
    stored = StructType([*new.schema.fields, StructField("batch_no", LongType()), StructField("fresh", BooleanType())])
    store.stage("scores", merged_scores(store.read("scores", stored, months), new, batch_id), months)
    first = stable(store.read("scores", stored, months).where("fresh").groupBy("model_id").agg(F.min("dt").alias("first")))
    if first.isEmpty():
        return False
    dates = new.select("model_id", "dt")
    store.stage("dates", store.read("dates", dates.schema, months).unionByName(dates).distinct(), months)
    first = first.join(strategies, "model_id", "left_semi")
    before = store.read("dates", dates.schema).join(first, "model_id").where(F.col("dt") < F.col("first"))
    span = first.join(before.groupBy("model_id").agg(F.max("dt").alias("prior")), "model_id", "left")
    span = stable(span)  # model_id, first, prior: a row for each model that is followed
    start, lowest = span.agg(F.min("first"), F.min(F.coalesce("prior", "first"))).first()
    if start is not None:
        _decide(store, strategies, span, stored, f"{start:%Y-%m}", f"{lowest:%Y-%m}")
    store.commit()
    return True


def _decide(store: Store, strategies: DataFrame, span: DataFrame, stored: StructType, since: str, lowest: str) -> None:
    """Stage the decisions of the models of ``span`` (model_id, first, prior) from their first date on."""
    strategies = stable(strategies)  # its size is known, so that ranks are not shuffled by model
    scores = store.read("scores", stored, since=lowest).drop("batch_no", "fresh").join(span, "model_id")
    ranked = stable(rank_scores(scores.where((F.col("dt") >= F.col("first")) | (F.col("dt") == F.col("prior")))))
    shape = _decision_schema(strategies, stored)
    affected = strategies.join(span, "model_id").select("strategy_id", "first", "prior")
    at_prior = store.read("decisions", shape, since=lowest).join(affected, "strategy_id").where("dt = prior AND status <> 'exit'")
    last = ranked.where(F.col("dt") == F.col("prior")).select("model_id", "dt", "kdcode", "rank")
    decisions = gate_batch(ranked.where(F.col("dt") >= F.col("first")), strategies, at_prior.select("strategy_id", "kdcode"), last)
    gone = affected.select("strategy_id", "first")
    kept = store.read("decisions", shape, since=since).join(gone, "strategy_id", "left").where("first IS NULL OR dt < first").select(*shape.names)
    touched = [m for m in store.months.get("dates", {}) if m >= since]
    store.stage("decisions", kept.unionByName(decisions), touched)


def gate_decisions(spark: SparkSession, path: str, strategies: DataFrame, scores: StructType) -> DataFrame:
    """T5. strategy_id, dt, kdcode, status, rank as of now."""
    return Store(spark, f"{path}/gate").read("decisions", _decision_schema(strategies, scores))


def run_gate(stream: DataFrame, strategies: DataFrame, path: str) -> DataFrame:
    """T5. Rank-drop gate over a stream of scores (model_id, dt, kdcode, score) in any order; see ``update_gate``."""
    run_batches(stream, path, lambda batch, n: update_gate(batch, strategies, path, n))
    return gate_decisions(stream.sparkSession, path, strategies, stream.schema)


# --- ledger ----------------------------------------------------------------------------------

def _ledger_schema(daily: StructType) -> tuple[StructType, StructType]:
    kind = daily["strategy_id"].dataType
    local = StructType([StructField("strategy_id", kind), StructField("dt", DateType())]
                       + [StructField(c, daily[c].dataType) for c in ("portfolio_return", "benchmark_return", "turnover", "num_trades", "num_holdings")]
                       + [StructField(c, DoubleType()) for c in LOCAL])
    months = StructType([StructField("strategy_id", kind), StructField("dt", DateType()), StructField("days", LongType()), *[StructField(c, DoubleType()) for c in LOCAL]])
    return local, months


def update_ledger(batch: DataFrame, path: str, spread_bps: float = 5.0, slippage_bps: float = 5.0) -> bool:
    """T6. Upsert the days of a batch (strategy_id, dt, portfolio_return, ..., seq) and bring the ledger up to date.

    Each month is kept as it runs by itself: its rows with the sums, the growth and the peak since its own first day, and
    one summary row per strategy. Months compose, so a batch reads and writes the months that it touches and no other,
    however much of the ledger follows them. Rows without strategy or date are left out.
    """
    store = Store(batch.sparkSession, f"{path}/ledger")
    batch = stable(batch.dropna(subset=["strategy_id", "dt"]))
    if not merge(store, "daily", batch, ["strategy_id", "dt"], "seq"):
        return False
    months = months_in(batch)
    rows = month_ledger(store.read("daily", batch.schema, months), spread_bps, slippage_bps)
    local, summary = _ledger_schema(batch.schema)
    store.stage("local", rows.select(*local.names), months)
    ends = month_summaries(store.read("local", local, months))
    store.stage("months", ends.select(*summary.names), months)
    store.commit()
    return True


def ledger_of(spark: SparkSession, path: str, daily: StructType, digits: int | None = 6, spread_bps: float = 5.0, slippage_bps: float = 5.0, since: str | None = None) -> DataFrame:
    """T6. The ledger as of now, or its months from ``since`` (yyyy-MM) on: the rows of these months, each composed with
    the summaries of the months before it."""
    store = Store(spark, f"{path}/ledger")
    local, summary = _ledger_schema(daily)
    return compose_ledger(store.read("local", local, since=since), store.read("months", summary), digits, spread_bps, slippage_bps)


def run_ledger(stream: DataFrame, path: str, digits: int | None = 6) -> DataFrame:
    """T6. Ledger kept up to date over a stream of days."""
    run_batches(stream, path, lambda batch, _: update_ledger(batch, path))
    return ledger_of(stream.sparkSession, path, stream.schema, digits)
