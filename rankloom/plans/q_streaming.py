"""Streams over the driver's files, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import drift as dr
from rankloom.operators import normalize as no
from rankloom.plans import testdata as td
from rankloom.plans.q_portfolio import gate_fold_sql
from rankloom.plans.q_ledger import ledger_input
from rankloom.plans.registry import check_sql, query, r, rounded, share, sig, significant
from rankloom.session import new_path, stable
from rankloom.streaming import jobs

END = "2024-01-11"


def event_stream(spark, sf):
    raw = jobs.read_files(spark, sf, td.table(spark, sf, "events"), "events.parquet")
    return raw.select(F.col("user_id").alias("kdcode"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


@query(
    "t1_stream_bars",
    f"""SELECT user_id AS kdcode, CAST(ts AS DATE) AS dt, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
    {r('sum(value)', 4)} AS volume FROM events WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def t1(spark, sf):
    df = jobs.run_to_table(jobs.daily_bars(event_stream(spark, sf)), new_path(spark, "bars"))
    return rounded(df, "volume", digits=4)


@query("t2_stream_append", check_sql("bars_m", f"SELECT kdcode, dt, {r('close', 7)} AS close, volume + 1 AS volume FROM bars_m"))
def t2(spark, sf):
    """Two versions of every bar arrive in several files; the later version stays."""
    m = td.bars_m(spark, sf).select("kdcode", "dt", "close", "volume")
    both = m.withColumn("seq", F.lit(0)).unionByName(m.withColumn("volume", F.col("volume") + 1).withColumn("seq", F.lit(1)))
    src = new_path(spark, "arrivals")
    both.repartition(4, "dt").write.parquet(src)
    stream = jobs.read_files(spark, src, spark.read.parquet(src), files_per_batch=2)
    return rounded(jobs.append_panel(stream, new_path(spark, "panel")).drop("seq"), "close", digits=7)


share("price_stats", f"SELECT avg(price) AS m, stddev_samp(price) AS s FROM ticks WHERE dt <= DATE '{td.TRAIN_END}'", "ticks")


@query(
    "t3_stream_enrich",
    check_sql(
        "ticks pit price_stats",
        f"""SELECT t.kdcode, t.dt, t.seq, {r('(least(greatest(t.price, m - 3 * s), m + 3 * s) - m) / s')} AS price FROM ticks t, price_stats
    WHERE EXISTS (SELECT 1 FROM pit p WHERE p.kdcode = t.kdcode AND t.dt BETWEEN p.valid_from AND p.valid_to)""",
    ),
)
def t3(spark, sf):
    stats = no.train_stats(td.ticks(spark, sf), ["price"], td.TRAIN_END)
    raw = jobs.read_files(spark, sf, td.table(spark, sf, "lineitem"), "lineitem.parquet")
    ticks = raw.select(
        F.col("l_suppkey").alias("kdcode"), F.col("l_shipdate").cast("date").alias("dt"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    # Saved statistics are a table, as they would be for a running job.
    saved = new_path(spark, "stats")
    stats.write.parquet(saved)
    out = jobs.enrich(ticks, td.pit_universe(td.bars_d(spark, sf)), spark.read.parquet(saved), ["price"])
    return rounded(jobs.run_to_table(out, new_path(spark, "enriched")), "price")


share("ev", "SELECT CAST(ts AS DATE) AS dt, ts, value::DOUBLE AS v FROM events")
share(
    "ev_edges",
    "WITH q AS (" + " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(v, {i / 10}) AS q FROM ev WHERE ts < '{END}'" for i in range(11))
    + ") SELECT a.i, max(b.q + (a.i - b.i) * 1e-9) AS e FROM q a JOIN q b ON b.i <= a.i GROUP BY 1",
    "ev",
)
share("ev_bins", "SELECT a.i AS bin, a.e AS lo, b.e AS hi FROM ev_edges a JOIN ev_edges b ON b.i = a.i + 1", "ev_edges")
share("ev_hit", "SELECT ev.*, b.bin FROM ev JOIN ev_bins b ON v >= b.lo AND (v < b.hi OR (b.bin = 9 AND v <= b.hi))", "ev ev_bins")


@query(
    "t4_stream_drift",
    check_sql(
        "ev ev_bins ev_hit",
        f"""WITH d AS (SELECT dt, count(*) AS n FROM ev WHERE dt + 1 <= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY GROUP BY 1),
    e AS (SELECT b.bin, count(h.v) / sum(count(h.v)) OVER () AS e FROM ev_bins b LEFT JOIN ev_hit h ON h.bin = b.bin AND h.ts < '{END}' GROUP BY 1),
    o AS (SELECT d.dt, b.bin, count(h.v) / greatest(sum(count(h.v)) OVER (PARTITION BY d.dt), 1e-8) AS o FROM d CROSS JOIN ev_bins b LEFT JOIN ev_hit h ON h.dt = d.dt AND h.bin = b.bin GROUP BY 1, 2),
    g AS (SELECT o.dt, o.bin, greatest(o, 1e-8) AS o, greatest(e, 1e-8) AS e, abs(sum(o - e) OVER (PARTITION BY o.dt ORDER BY o.bin ROWS UNBOUNDED PRECEDING)) AS gap FROM o JOIN e USING (bin)),
    m AS (SELECT dt, sum((o - e) * ln(o / e)) AS psi, max(gap) AS ks FROM g GROUP BY 1)
    SELECT m.dt, 'value' AS feature, {r('psi')} AS psi, {r('ks')} AS ks, CASE WHEN psi >= 0.25 OR ks >= 0.2 THEN 'ALERT' WHEN psi >= 0.1 OR ks >= 0.1 THEN 'WARN' ELSE 'OK' END AS status,
    d.n AS observed_count FROM m JOIN d USING (dt)""",
    ),
)
def t4(spark, sf):
    train = td.event_ticks(spark, sf).where(F.col("ts") < F.lit(END).cast("timestamp"))
    saved = new_path(spark, "reference")
    dr.feature_reference(train, ["value"]).write.parquet(saved)
    reference = spark.read.parquet(saved)
    counts = jobs.run_to_table(jobs.bin_counts(event_stream(spark, sf), reference, ["value"]), new_path(spark, "counts"))
    return rounded(jobs.drift_by_day(counts, reference), "psi", "ks")


_gate_days = """gate_days AS (SELECT s.strategy_id AS key, d.day_no AS seq, d.day_no, any_value(d.dt) AS dt, any_value(s.top_k) AS top_k, false AS daily,
      list({'k': k.kdcode, 'rank': k.rank, 'fell': coalesce(k.rank - p.rank >= s.min_rank_drop, false), 'real': true} ORDER BY k.rank) AS names
    FROM gated s JOIN model_days d ON d.model_id = s.model_id JOIN ranked k ON k.model_id = d.model_id AND k.dt = d.dt
    LEFT JOIN model_days b ON b.model_id = d.model_id AND b.day_no = d.day_no - 1
    LEFT JOIN ranked p ON p.model_id = d.model_id AND p.dt = b.dt AND p.kdcode = k.kdcode GROUP BY 1, 2, 3)"""


@query(
    "t5_stream_gate",
    check_sql(
        "ranked gated",
        f"""WITH model_days AS (SELECT model_id, dt, row_number() OVER (PARTITION BY model_id ORDER BY dt) AS day_no FROM (SELECT DISTINCT model_id, dt FROM ranked)),
    {_gate_days},
    {gate_fold_sql('gate_days')},
    named AS (SELECT d.key AS strategy_id, d.dt, f.was, f.stay, f.target, unnest(d.names) AS n FROM gate_days d JOIN fold f ON f.key = d.key AND f.seq = d.seq)
    SELECT strategy_id, dt, n.k AS kdcode, 'survivor' AS status, n.rank AS rank FROM named WHERE list_contains(stay, n.k)
    UNION ALL SELECT strategy_id, dt, n.k, 'exit', n.rank FROM named WHERE list_contains(was, n.k) AND n.fell
    UNION ALL SELECT strategy_id, dt, n.k, 'entry', n.rank FROM named WHERE list_contains(target, n.k) AND NOT list_contains(stay, n.k)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def t5(spark, sf):
    """Dates are split over files and arrive late: odd names of 1999 after 2000, model 1 after the others, in two halves."""
    s = td.scores(spark, sf)
    odd, one = F.col("kdcode") % 2 == 1, F.col("model_id") == 1
    year = F.year("dt")
    arrival = F.when(one, F.when(odd, 4).otherwise(3)).when(year >= 2000, 1).when((year == 1999) & odd, 2).otherwise(0)
    s = stable(s.withColumn("arrival", arrival))
    src, gate = new_path(spark, "scores"), new_path(spark, "gate")
    followed = td.strategies(spark).where("min_rank_drop > 0")
    for k in range(5):
        # An arrival is written by as many tasks as it needs and is one batch of the stream, which goes on from its checkpoint.
        s.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(src)
        decisions = jobs.run_gate(jobs.read_files(spark, src, s.drop("arrival")), followed, gate)
    return decisions


_small = ("portfolio_return", "net_return", "benchmark_return", "excess_return", "cum_return", "cum_benchmark", "drawdown", "est_cost")


@query(
    "t6_stream_ledger",
    check_sql(
        "ledger",
        "SELECT strategy_id, dt, num_trades, num_holdings, " + ", ".join(f"{r(c)} AS {c}" for c in _small)
        + f", {sig('equity')} AS equity, {sig('peak_equity')} AS peak_equity, {r('turnover', 4)} AS turnover FROM ledger",
    ),
)
def t6(spark, sf):
    """The second half of the months arrives first, then stale rows of all months, then the first half."""
    src = new_path(spark, "days")
    d = ledger_input(spark, sf)
    late = F.col("dt") >= "1995-01-01"
    for part in (d.where(late & (F.col("seq") == 1)), d.where("seq = 0"), d.where(~late & (F.col("seq") == 1))):
        part.repartition(1).write.mode("append").parquet(src)
    stream = jobs.read_files(spark, src, spark.read.parquet(src), files_per_batch=1)
    df = jobs.run_ledger(stream, new_path(spark, "ledger"), digits=None)
    return rounded(rounded(significant(df, "equity", "peak_equity"), *_small), "turnover", digits=4)
