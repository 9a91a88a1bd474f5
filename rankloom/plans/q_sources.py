"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded
from rankloom.session import new_path
from rankloom.sources import macro, panel, sinks
from rankloom.sources.bars import bars_from_ticks


@query(
    "s1_panel_scan",
    """SELECT l_suppkey AS kdcode, CAST(l_shipdate AS DATE) AS dt, count(*) AS n_rows, sum(l_quantity) AS volume
    FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate <= '1999-12-31' GROUP BY 1, 2""",
)
def s1(spark, sf):
    df = panel.scan_panel(
        spark, f"{sf}/lineitem.parquet", "1996-01-01", "1999-12-31", date="l_shipdate",
        columns=["l_suppkey", "l_shipdate", "l_quantity"],
    )
    return df.groupBy(F.col("l_suppkey").alias("kdcode"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.count("*").alias("n_rows"), F.sum("l_quantity").alias("volume")
    )


@query(
    "s2_index_series",
    f"""SELECT 'INDEX' AS kdcode, CAST(o_orderdate AS DATE) AS dt,
    {r("arg_max(o_totalprice, o_orderkey)", 2)} AS open, {r("arg_max(o_totalprice, o_orderkey)", 2)} AS high,
    {r("arg_max(o_totalprice, o_orderkey)", 2)} AS low, {r("arg_max(o_totalprice, o_orderkey)", 2)} AS close, 0::DOUBLE AS volume
    FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '2000-12-31' GROUP BY 2""",
)
def s2(spark, sf):
    raw = td.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("dt"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("seq")
    )
    return rounded(panel.index_series(raw, "seq", "1996-01-01", "2000-12-31"), "open", "high", "low", "close", digits=2)


_raw_series = """raw AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS dt,
    CASE WHEN day(l_shipdate) IN (1, 15, 16) THEN NULL ELSE sum(l_quantity) END AS value
    FROM lineitem GROUP BY 1, 2, day(l_shipdate))"""


def raw_series(spark, sf):
    """Daily text values per return flag; '.' marks a missing one."""
    return (
        td.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("dt"))
        .agg(F.sum("l_quantity").cast("bigint").cast("string").alias("v"))
        .select("series_id", "dt", F.when(F.dayofmonth("dt").isin(1, 15, 16), F.lit(".")).otherwise(F.col("v")).alias("value"))
    )


@query(
    "s3_series_shaping",
    f"""WITH {_raw_series}, filled AS (SELECT series_id, dt, coalesce(
      last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM raw),
    lagged AS (SELECT series_id, dt, lag(value) OVER (PARTITION BY series_id ORDER BY dt) AS value FROM filled)
    SELECT * FROM lagged WHERE dt BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'""",
)
def s3(spark, sf):
    return macro.shape_series(raw_series(spark, sf), 1, "1995-01-01", "2000-12-31")


@query(
    "s4_credit_pair",
    check_sql(
        "macro_d",
        f"""WITH ig AS (SELECT dt, ig_spread FROM macro_d WHERE dayofweek(dt) <> 1),
    hy AS (SELECT dt, hy_spread FROM macro_d WHERE day(dt) <> 10),
    j AS (SELECT dt, ig_spread, hy_spread FROM ig FULL JOIN hy USING (dt)),
    f AS (SELECT dt, last_value(ig_spread IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ig_spread,
      last_value(hy_spread IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hy_spread FROM j),
    b AS (SELECT dt, first_value(ig_spread IGNORE NULLS) OVER w AS ig_spread, first_value(hy_spread IGNORE NULLS) OVER w AS hy_spread FROM f
      WHERE ig_spread IS NOT NULL OR hy_spread IS NOT NULL WINDOW w AS (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    s AS (SELECT dt, lag(ig_spread) OVER (ORDER BY dt) AS ig_spread, lag(hy_spread) OVER (ORDER BY dt) AS hy_spread FROM b)
    SELECT dt, {r('ig_spread')} AS ig_spread, {r('hy_spread')} AS hy_spread FROM s
    WHERE dt BETWEEN DATE '1995-01-01' AND DATE '2001-06-30' AND (ig_spread IS NOT NULL OR hy_spread IS NOT NULL)""",
    ),
)
def s4(spark, sf):
    m = td.macro_d(spark, sf)
    ig = m.where(F.dayofweek("dt") != 2).select("dt", F.col("ig_spread").alias("value"))
    hy = m.where(F.dayofmonth("dt") != 10).select("dt", F.col("hy_spread").alias("value"))
    return rounded(macro.credit_pair(ig, hy, "1995-01-01", "2001-06-30"), "ig_spread", "hy_spread")


_vars = list(td.REGIME_OF_PRIORITY.values())


def _fill(c, w):
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" first_value({c} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


@query(
    "s5_regime_file",
    "WITH one AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_orderstatus AS seq, "
    + ", ".join(f"max(CAST(floor(o_totalprice) AS BIGINT)) FILTER (o_orderpriority = '{p}') AS {v}" for p, v in td.REGIME_OF_PRIORITY.items())
    + " FROM orders GROUP BY 1, 2), last AS (SELECT dt, "
    + ", ".join(f"max({v}) FILTER (seq = top) AS {v}" for v in _vars)
    + " FROM (SELECT *, max(seq) OVER (PARTITION BY dt) AS top FROM one) GROUP BY dt), lagged AS (SELECT dt, "
    + ", ".join(f"lag({v}, 2) OVER (ORDER BY dt) AS {v}" for v in _vars)
    + " FROM last) SELECT dt, "
    + ", ".join(f"CAST({_fill(v, '')} AS DOUBLE) AS {v}" for v in _vars)
    + ", NULL::DOUBLE AS regime_monetary_policy, NULL::DOUBLE AS regime_volatility FROM lagged",
)
def s5(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in td.REGIME_OF_PRIORITY.items() for x in kv])
    raw = (
        td.table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("dt"), F.col("o_orderstatus").alias("seq"))
        .pivot("o_orderpriority", list(td.REGIME_OF_PRIORITY))
        .agg(F.coalesce(F.max(F.floor("o_totalprice")).cast("string"), F.lit(".")))
    )
    del names
    raw = raw.withColumnsRenamed(td.REGIME_OF_PRIORITY)
    return macro.regime_file(raw, "seq", lag_rows=2)


_assembly_ids = {
    "regime_market": "market", "regime_copper": "copper", "regime_yield_curve": "yield_10y",
    "regime_stock_bond_corr": "yield_3m", "regime_oil": "oil",
}


def assembly_series(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in _assembly_ids.items() for x in kv])
    return (
        td.regime_long(spark, sf)
        .select(names[F.col("series_id")].alias("series_id"), "dt", "value")
        .unionByName(td.macro_d(spark, sf).select(F.lit("vix").alias("series_id"), "dt", F.col("vix").alias("value")))
    )


_p = {v: f"max(value) FILTER (series_id = '{k}')" for k, v in _assembly_ids.items()}


@query(
    "s6_regime_assembly",
    check_sql(
        "regime_long macro_d",
        f"""WITH o AS (SELECT dt, {', '.join(f'{e} AS {n}' for n, e in _p.items())} FROM regime_long GROUP BY dt),
    b AS (SELECT dt, market, copper, yield_10y, yield_3m, oil, vix FROM o FULL JOIN (SELECT dt, vix FROM macro_d) USING (dt)),
    d AS (SELECT *, market / lag(market) OVER (ORDER BY dt) - 1 AS mr, yield_10y - lag(yield_10y) OVER (ORDER BY dt) AS dy FROM b),
    c AS (SELECT *, CASE WHEN count(CASE WHEN mr IS NOT NULL AND dy IS NOT NULL THEN 1 END) OVER w >= 21 THEN corr(mr, dy) OVER w END AS sbc,
      yield_10y - yield_3m AS yc FROM d WINDOW w AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
    SELECT dt, {r(_fill('market', ''), 4)} AS regime_market, {r(_fill('yc', ''), 4)} AS regime_yield_curve, {r(_fill('oil', ''), 4)} AS regime_oil,
      {r(_fill('copper', ''), 4)} AS regime_copper, {r(_fill('sbc', ''))} AS regime_stock_bond_corr,
      {r(_fill('yield_3m', ''), 4)} AS regime_monetary_policy, {r(_fill('vix', ''))} AS regime_volatility FROM c""",
    ),
)
def s6(spark, sf):
    df = macro.assemble_regime(assembly_series(spark, sf))
    df = rounded(df, "regime_stock_bond_corr", "regime_volatility")
    return rounded(
        df, "regime_market", "regime_yield_curve", "regime_oil", "regime_copper", "regime_monetary_policy", digits=4
    )


def candidate_sources(spark, sf):
    """Two sources per priority: finished orders first, all orders as fallback; two series lack the first."""
    o = td.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("dt"), "o_orderstatus", "o_totalprice"
    )
    keys = ["series_id", "dt"]
    first = (
        o.where((F.col("o_orderstatus") == "F") & ~F.col("series_id").isin("2-HIGH", "5-LOW"))
        .groupBy(*keys).agg(F.max("o_totalprice").alias("value")).withColumn("priority", F.lit(1))
    )
    second = o.groupBy(*keys).agg(F.max("o_totalprice").alias("value")).withColumn("priority", F.lit(2))
    return first.unionByName(second)


_cand = """cand AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS dt, max(o_totalprice) AS value, 1 AS priority
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('2-HIGH', '5-LOW') GROUP BY 1, 2
    UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE), max(o_totalprice), 2 FROM orders GROUP BY 1, 2)"""


@query(
    "s7_first_available",
    f"""WITH {_cand} SELECT series_id, priority, dt, value FROM cand c
    WHERE priority = (SELECT min(priority) FROM cand d WHERE d.series_id = c.series_id)""",
)
def s7(spark, sf):
    return macro.first_available(candidate_sources(spark, sf))


@query(
    "s7_missing_series",
    f"""WITH {_cand}, want(series_id) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('6-COPPER'))
    SELECT series_id FROM want WHERE series_id NOT IN (SELECT series_id FROM cand)""",
)
def s7_missing(spark, sf):
    return macro.missing_series(macro.first_available(candidate_sources(spark, sf)), ["1-URGENT", "2-HIGH", "6-COPPER"])


def order_series(spark, sf):
    return td.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"),
    )


@query(
    "s8_series_export",
    """WITH l AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS dt, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2)
    SELECT dt, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM l GROUP BY dt""",
)
def s8(spark, sf):
    return macro.export_series(order_series(spark, sf), ["F", "O", "P"])


@query(
    "s8_export_counts",
    "SELECT o_orderstatus AS series_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_rows FROM orders GROUP BY 1",
)
def s8_counts(spark, sf):
    return macro.export_counts(order_series(spark, sf))


FEATS = list(td.FEATURES_D)
_inst = {p: f"I{p[0]}.N" for p in td.REGIME_OF_PRIORITY}


def wide_vendor_frame(spark, sf):
    """dt x instrument|FIELD, with two aliases of the close that overlap."""
    o = td.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("dt"), "o_orderpriority", "o_totalprice", "o_orderkey", "o_orderstatus"
    )
    price = F.col("o_totalprice")
    aggs = {
        "OPEN": F.min_by(price, F.col("o_orderkey")), "HIGH": F.max(price), "LOW": F.min(price),
        "TRDPRC_1": F.max_by(F.when(F.col("o_orderstatus") == "F", price), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))),
        "CLOSE": F.max_by(F.when(F.col("o_orderstatus") != "P", price), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))),
        "VOLUME": F.count(F.lit(1)).cast("double"),
    }
    wide = o.groupBy("dt").pivot("o_orderpriority", list(_inst)).agg(*[a.alias(n) for n, a in aggs.items()])
    wide = wide.withColumnsRenamed({f"{p}_{n}": f"{i}|{n}" for p, i in _inst.items() for n in aggs})
    # every date comes three times: without closes, as it is, and with other values that must lose
    prices = [c for c in wide.columns if c != "dt"]
    empty = wide.select("dt", F.lit(0).alias("seq"), *[(F.lit(None).cast("double") if c.endswith(("CLOSE", "TRDPRC_1")) else F.col(f"`{c}`") * 3).alias(c) for c in prices])
    late = wide.select("dt", F.lit(2).alias("seq"), *[(F.col(f"`{c}`") * 2).alias(c) for c in prices])
    return empty.unionByName(wide.withColumn("seq", F.lit(1))).unionByName(late)


_wide_case = " ".join(f"WHEN '{p}' THEN '{i}'" for p, i in _inst.items())


@query(
    "s9_wide_reshape",
    f"""WITH a AS (SELECT CASE o_orderpriority {_wide_case} END AS kdcode, CAST(o_orderdate AS DATE) AS dt,
      arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
      coalesce(arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F'), arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'P')) AS close,
      count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)
    SELECT *, {r('volume * close', 2)} AS turnover FROM a WHERE close IS NOT NULL""",
)
def s9(spark, sf):
    return rounded(panel.reshape_wide(wide_vendor_frame(spark, sf)), "turnover", digits=2)


@query(
    "s10_flat_reshape",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_orderstatus AS s, o_orderkey AS seq, o_totalprice AS p FROM orders
      WHERE o_orderstatus <> 'P')
    SELECT 'SPX' AS kdcode, dt, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low,
      arg_min(p, seq) AS close, 1::DOUBLE AS volume FROM a GROUP BY dt""",
)
def s10(spark, sf):
    o = td.table(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderdate").cast("date").alias("dt"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("TRDPRC_1"),
        F.lit("1").alias("ACVOL_UNS"), F.lit(".").alias("MKT_OPEN"),
    )
    return panel.reshape_flat(raw, "SPX", "seq")


@query(
    "s11_identifiers",
    r"""SELECT s_suppkey, regexp_replace(s_name || '.A.N', '\.[^.]*$', '') AS ticker,
    replace(trim(' ' || s_name || '.B '), '.', '-') AS yahoo FROM supplier""",
)
def s11(spark, sf):
    s = td.table(spark, sf, "supplier")
    return s.select(
        "s_suppkey",
        panel.strip_exchange(F.concat("s_name", F.lit(".A.N"))).alias("ticker"),
        panel.yahoo_ticker(F.concat(F.lit(" "), "s_name", F.lit(".B "))).alias("yahoo"),
    )


def increment(spark, sf):
    """A base up to mid 2000 and a revised increment that overlaps it."""
    m = td.bars_m(spark, sf).select("kdcode", "dt", "close", "volume")
    base = m.where("dt < DATE '2000-07-01'")
    new = m.where("dt >= DATE '2000-01-01'").withColumn("volume", F.col("volume") + 1)
    return base, new


_incr = """base AS (SELECT kdcode, dt, close, volume FROM bars_m WHERE dt < DATE '2000-07-01'),
    merged AS (SELECT kdcode, dt, close, CASE WHEN dt >= DATE '2000-04-01' THEN volume + 1 ELSE volume END AS volume FROM bars_m)"""


@query(
    "s12_incremental_append",
    check_sql("bars_m", f"WITH {_incr} SELECT kdcode, dt, {r('close', 7)} AS close, volume FROM merged"),
)
def s12(spark, sf):
    base, new = increment(spark, sf)
    return rounded(panel.append_increment(base, new, "2000-04-01"), "close", digits=7)


@query(
    "s12_append_report",
    check_sql(
        "bars_m",
        f"""WITH {_incr} SELECT (SELECT count(*) FROM base) AS rows_before, (SELECT count(*) FROM merged) AS rows_after,
    (SELECT count(*) FROM merged) - (SELECT count(*) FROM base) AS rows_added""",
    ),
)
def s12_report(spark, sf):
    base, new = increment(spark, sf)
    return panel.append_report(base, panel.append_increment(base, new, "2000-04-01"))


@query(
    "s13_score_files",
    check_sql("scores", f"SELECT model_id, dt, kdcode::VARCHAR AS kdcode, {r('score', 5)} AS score FROM scores"),
)
def s13(spark, sf):
    path = sinks.write_scores(td.scores(spark, sf), new_path(spark, "scores"))
    return rounded(panel.load_scores(spark, path), "score", digits=5)


@query("s14_score_tables", check_sql("scores", f"SELECT model_id, dt AS date, count(*) AS n_rows, min(kdcode::VARCHAR) AS first_code, arg_max(kdcode::VARCHAR, score) AS best_code FROM scores GROUP BY 1, 2"))
def s14(spark, sf):
    path = sinks.write_scores(td.scores(spark, sf), new_path(spark, "scores"), fmt="parquet")
    out = spark.read.parquet(path).groupBy("model_id", "date").agg(
        F.count("*").alias("n_rows"), F.min(F.col("kdcode").cast("string")).alias("first_code"), F.max_by(F.col("kdcode").cast("string"), "score").alias("best_code")
    )
    return out


@query("s14_feature_tables", check_sql("features_d", "SELECT kdcode, dt, " + ", ".join(f"{r(c)} AS {c}" for c in FEATS) + " FROM features_d"))
def s14_features(spark, sf):
    path = sinks.write_features(td.features_d(spark, sf).select("kdcode", "dt", *FEATS), new_path(spark, "features"))
    return rounded(spark.read.parquet(path).select("kdcode", "dt", *FEATS), *FEATS)


_cell = " || ".join(f"'{c}=' || coalesce(length({e}) || '''' || {e}, 'NULL') || ';'" for c, e in (("kdcode", "c_custkey::VARCHAR"), ("name", "c_name"), ("dt", "(CASE WHEN c_custkey % 7 > 0 THEN DATE '2024-01-01' + (c_custkey % 30)::INTEGER END)::VARCHAR")))


@query(
    "s16_fingerprint",
    f"""WITH c AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 3 = 0),
    h AS (SELECT md5({_cell}) AS d, CASE WHEN c_custkey % 7 > 0 THEN DATE '2024-01-01' + (c_custkey % 30)::INTEGER END AS dt FROM c)
    SELECT sum(('0x' || substr(d, 1, 12))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(d, 13, 12))::BIGINT)::VARCHAR AS row_hash, count(*) AS n_rows, min(dt) AS first_dt, max(dt) AS last_dt FROM h""",
)
def s16(spark, sf):
    """Rows with NULL dates, a third of them twice."""
    c = td.table(spark, sf, "customer")
    day = F.when(F.col("c_custkey") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")))
    rows = c.unionByName(c.where("c_custkey % 3 = 0")).select(F.col("c_custkey").alias("kdcode"), F.col("c_name").alias("name"), day.alias("dt"))
    return panel.fingerprint(rows)


@query(
    "s17_bars_from_ticks",
    check_sql(
        "bars_d", f"SELECT kdcode, dt, {r('open', 7)} AS open, {r('high', 7)} AS high, {r('low', 7)} AS low, {r('close', 7)} AS close, volume FROM bars_d"
    ),
)
def s17(spark, sf):
    return rounded(td.bars_d(spark, sf), "open", "high", "low", "close", digits=7)


@query(
    "s17_event_bars",
    f"""SELECT user_id AS kdcode, CAST(ts AS DATE) AS dt, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, event_id) AS close, {r('sum(value)', 4)} AS volume FROM events GROUP BY 1, 2""",
)
def s17_events(spark, sf):
    t = td.event_ticks(spark, sf).withColumn("dt", F.to_date("ts"))
    return rounded(bars_from_ticks(t, ["kdcode", "dt"], "value", "value", "event_id"), "volume", digits=4)
