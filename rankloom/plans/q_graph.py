"""Correlation graph of the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import graph as gr
from rankloom.plans import testdata as td
from rankloom.plans.registry import check_sql, query, r, rounded, share

ONE = ["2001-11-01"]
START, END, MONTHS, LOOK = "2000-01-01", "2001-10-01", 7, 252


def snaps(spark, schedule=False):
    return gr.snapshot_dates(spark, START, END, MONTHS) if schedule else gr.snapshot_list(spark, ONE)


share("snap_one", "SELECT DATE '2001-11-01' AS valid_from")
share("snap_all", f"SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL {MONTHS} MONTH)) AS DATE) AS valid_from")


def share_rows(name: str, op: str, look: int) -> None:
    share(
        f"rows_{name}",
        f"""WITH d AS (SELECT s.valid_from, x.dt, row_number() OVER (PARTITION BY s.valid_from ORDER BY x.dt DESC) AS k
      FROM snap_{name} s JOIN (SELECT DISTINCT dt FROM daily_ret) x ON x.dt {op} s.valid_from QUALIFY k <= {look}),
    o AS (SELECT d.valid_from, q.kdcode, d.dt, q.ret FROM d JOIN daily_ret q ON q.dt = d.dt WHERE q.ret IS NOT NULL),
    p AS (SELECT valid_from, dt, row_number() OVER (PARTITION BY valid_from ORDER BY dt) - 1 AS pos, count(*) OVER (PARTITION BY valid_from) AS n FROM (SELECT DISTINCT valid_from, dt FROM o))
    SELECT o.valid_from, o.kdcode, p.pos, p.n, o.ret FROM o JOIN p ON p.valid_from = o.valid_from AND p.dt = o.dt""",
        f"daily_ret snap_{name}",
    )
    share(
        f"grid_{name}",
        f"""SELECT k.valid_from, k.kdcode, p.pos, coalesce(r.ret, 0) AS ret FROM (SELECT DISTINCT valid_from, kdcode FROM rows_{name}) k
    JOIN (SELECT DISTINCT valid_from, pos FROM rows_{name}) p ON p.valid_from = k.valid_from
    LEFT JOIN rows_{name} r ON r.valid_from = k.valid_from AND r.kdcode = k.kdcode AND r.pos = p.pos""",
        f"rows_{name}",
    )
    share(
        f"corr_{name}",
        f"""SELECT a.valid_from, a.kdcode AS src, b.kdcode AS dst, corr(a.ret, b.ret) AS corr FROM grid_{name} a
    JOIN grid_{name} b ON a.valid_from = b.valid_from AND a.pos = b.pos AND a.kdcode <> b.kdcode GROUP BY 1, 2, 3""",
        f"grid_{name}",
    )


share_rows("one", "<", LOOK)
share_rows("all", "<", LOOK)


@query("e1_return_rows", check_sql("rows_all", f"SELECT valid_from, kdcode, pos, n, {r('ret')} AS ret FROM rows_all"))
def e1(spark, sf):
    return rounded(gr.return_rows(td.bars_d(spark, sf), snaps(spark, True), LOOK), "ret")


@query("e2_correlation", check_sql("corr_one", f"SELECT valid_from, src, dst, {r('corr')} AS corr FROM corr_one WHERE corr IS NOT NULL"))
def e2(spark, sf):
    return rounded(gr.cells(gr.correlation_matrix(gr.return_rows(td.bars_d(spark, sf), snaps(spark), LOOK))), "corr")


def _attrs(rank: str) -> str:
    return f"valid_from, src, dst, {r('corr')} AS corr, {r('abs(corr)')} AS abs_corr, {r('corr * corr')} AS corr_sq, {r(rank)} AS rank_pct"


ATTRS = ("corr", "abs_corr", "corr_sq", "rank_pct")


@query("e3_threshold_edges", check_sql("corr_one", f"SELECT {_attrs('0')} FROM corr_one WHERE corr > 0.3"))
def e3(spark, sf):
    return rounded(gr.build_graph(td.bars_d(spark, sf), snaps(spark), gr.Selection(threshold=0.3), LOOK), *ATTRS)


def share_top(name: str, metric: str, label: str) -> None:
    share(
        f"top_{label}",
        f"""SELECT *, (max(pos) OVER (PARTITION BY valid_from, src) - pos + 1)::DOUBLE / max(pos) OVER (PARTITION BY valid_from, src) AS rank_pct FROM
    (SELECT *, row_number() OVER (PARTITION BY valid_from, src ORDER BY {metric} DESC, dst) AS pos FROM corr_{name} WHERE corr IS NOT NULL) WHERE pos <= 5""",
        f"corr_{name}",
    )


share_top("one", "corr", "corr")
share_top("one", "abs(corr)", "abs")
share_top("all", "abs(corr)", "all")


@query("e4_top_k_edges", check_sql("top_corr", f"SELECT {_attrs('rank_pct')} FROM top_corr"))
def e4(spark, sf):
    return rounded(gr.build_graph(td.bars_d(spark, sf), snaps(spark), gr.Selection(top_k=5), LOOK), *ATTRS)


@query("e5_edge_attributes", check_sql("top_abs", f"SELECT {_attrs('rank_pct')} FROM top_abs"))
def e5(spark, sf):
    return rounded(gr.build_graph(td.bars_d(spark, sf), snaps(spark), gr.Selection(top_k=5, metric="abs_corr"), LOOK), *ATTRS)


_lag_rows = " UNION ALL ".join(
    f"""SELECT e.src, e.dst, {k} AS lag, {i} AS ord, corr(a.ret, b.ret) AS c, count(*) AS m, stddev_pop(a.ret) AS sa, stddev_pop(b.ret) AS sb
    FROM top_corr e JOIN grid_one a ON a.kdcode = e.src JOIN grid_one b ON b.kdcode = e.dst AND b.pos = a.pos + {k} GROUP BY 1, 2"""
    for i, k in enumerate((0, 1, 2, 3, 5))
)


@query(
    "e6_lead_lag",
    check_sql(
        "top_corr grid_one",
        f"""WITH l AS ({_lag_rows}), b AS (SELECT src, dst, lag, c, row_number() OVER (PARTITION BY src, dst ORDER BY abs(c) DESC, ord) AS k FROM l WHERE m >= 5 AND sa >= 1e-12 AND sb >= 1e-12)
    SELECT e.src, e.dst, {r('e.corr')} AS corr, {r('coalesce(b.lag, 0) / 5.0')} AS lag_norm, {r('coalesce(b.c, 0)')} AS lag_corr
    FROM top_corr e LEFT JOIN b ON b.src = e.src AND b.dst = e.dst AND b.k = 1""",
    ),
)
def e6(spark, sf):
    rows = gr.return_rows(td.bars_d(spark, sf), snaps(spark), LOOK)
    sel = gr.Selection(top_k=5)
    df = gr.add_lead_lag(gr.rank_edges(gr.correlate(rows, sel), sel), rows)
    return rounded(df.select("src", "dst", "corr", "lag_norm", "lag_corr"), "corr", "lag_norm", "lag_corr")


@query("e7_snapshots", check_sql("top_all", f"SELECT {_attrs('rank_pct')} FROM top_all"))
def e7(spark, sf):
    sel = gr.Selection(top_k=5, metric="abs_corr")
    return rounded(gr.build_graph(td.bars_d(spark, sf), snaps(spark, True), sel, LOOK), *ATTRS)


_lookup = """SELECT t.kdcode, t.dt, coalesce(s.valid_from, (SELECT min(valid_from) FROM snap_all)) AS valid_from
    FROM bars_m t ASOF LEFT JOIN snap_all s ON t.dt >= s.valid_from"""


@query("e8_snapshot_lookup", check_sql("bars_m snap_all", _lookup))
def e8(spark, sf):
    return gr.snapshot_for_dates(td.bars_m(spark, sf).select("kdcode", "dt"), snaps(spark, True)).select("kdcode", "dt", "valid_from")


@query("e9_snapshot_age", check_sql("bars_m snap_all", f"SELECT kdcode, dt, date_diff('day', valid_from, dt) AS age_days FROM ({_lookup})"))
def e9(spark, sf):
    return gr.snapshot_for_dates(td.bars_m(spark, sf).select("kdcode", "dt"), snaps(spark, True)).select("kdcode", "dt", "age_days")


@query(
    "e10_update_due",
    check_sql("ticks", "SELECT dt, (year(dt) - 1998) * 12 + month(dt) - 5 >= 6 AS due, false AS due_never, true AS due_first FROM (SELECT DISTINCT dt FROM ticks)"),
)
def e10(spark, sf):
    last = F.lit("1998-05-20").cast("date")
    return td.ticks(spark, sf).select("dt").distinct().select(
        "dt",
        gr.update_due(F.col("dt"), last, 6).alias("due"),
        gr.update_due(F.col("dt"), last, 0).alias("due_never"),
        gr.update_due(F.col("dt"), F.lit(None).cast("date"), 6).alias("due_first"),
    )


@query(
    "e11_sector_edges",
    """WITH s AS (SELECT s_suppkey AS kdcode, CASE WHEN s_acctbal <= 0 THEN 'UNKNOWN' ELSE s_nationkey::VARCHAR END AS sector FROM supplier),
    p AS (SELECT a.kdcode AS src, b.kdcode AS dst, row_number() OVER (PARTITION BY a.kdcode ORDER BY b.kdcode) AS k FROM s a JOIN s b ON a.sector = b.sector AND a.kdcode <> b.kdcode)
    SELECT src, dst, 1::DOUBLE AS weight FROM p WHERE k <= 3""",
)
def e11(spark, sf):
    """Suppliers with no positive balance have no known sector."""
    s = td.table(spark, sf, "supplier")
    known = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("kdcode"), F.col("s_nationkey").cast("string").alias("sector"))
    return gr.sector_edges(s.select(F.col("s_suppkey").alias("kdcode")), known, 3)


@query(
    "e12_graph_stats",
    check_sql(
        "top_all",
        f"""SELECT valid_from, count(*) AS n_edges, count(*) // 2 AS n_unique_edges, {r('avg(corr)')} AS avg_weight, {r('min(corr)')} AS min_weight, {r('max(corr)')} AS max_weight
    FROM top_all GROUP BY 1""",
    ),
)
def e12(spark, sf):
    sel = gr.Selection(top_k=5, metric="abs_corr")
    df = gr.graph_stats(gr.build_graph(td.bars_d(spark, sf), snaps(spark, True), sel, LOOK))
    return rounded(df, "avg_weight", "min_weight", "max_weight")


share_rows("incl", "<=", 250)
share("snap_incl", "SELECT DATE '2000-12-29' AS valid_from")


@query(
    "e13_mean_filled_correlation",
    check_sql(
        "rows_incl",
        f"""WITH m AS (SELECT kdcode, avg(ret) AS m FROM rows_incl GROUP BY kdcode), g AS (SELECT m.kdcode, p.pos, coalesce(r.ret, m.m) AS ret FROM m CROSS JOIN (SELECT DISTINCT pos FROM rows_incl) p
      LEFT JOIN rows_incl r ON r.kdcode = m.kdcode AND r.pos = p.pos),
    c AS (SELECT a.kdcode AS src, b.kdcode AS dst, corr(a.ret, b.ret) AS corr FROM g a JOIN g b ON a.pos = b.pos AND a.kdcode <> b.kdcode GROUP BY 1, 2)
    SELECT src, dst, {r('corr')} AS corr FROM c WHERE corr IS NOT NULL""",
    ),
)
def e13(spark, sf):
    rows = gr.return_rows(td.bars_d(spark, sf), gr.snapshot_list(spark, ["2000-12-29"]), 250, inclusive=True)
    return rounded(gr.cells(gr.correlation_matrix(rows, fill="mean")).select("src", "dst", "corr"), "corr")
