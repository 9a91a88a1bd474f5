"""The physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions.ranking import top_k
from rankloom.plans import testdata as td
from rankloom.plans.catalog import ORACLES, QUERIES
from rankloom.sources.panel import scan_panel

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["f2_price_features", "f12_momentum_binary", "f15_volatility", "n2_normalise", "c4_complete_entities", "c10_impute", "c3_min_history", "v3_daily_ic", "v6_top_k_daily", "l3_forward_labels", "s12_incremental_append", "b1_return_columns"],
)
def test_panel_never_goes_to_one_task(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # A single partition is allowed for one-row aggregates only, never below a window or a sort.
    for line in p.splitlines():
        if "SinglePartition" in line:
            assert "Window" not in p.split(line)[0][-400:], name


def test_scan_pushes_range_and_columns(spark):
    df = scan_panel(spark, f"{SF}/lineitem.parquet", "1996-01-01", "1997-01-01", date="l_shipdate", columns=["l_suppkey", "l_shipdate"])
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp_ntz>" in p


def test_top_k_limits_before_the_shuffle(spark):
    p = plan(top_k(td.scores(spark, SF), ["model_id", "dt"], [F.desc("score"), F.asc("kdcode")], 5))
    assert p.count("WindowGroupLimit") == 2


def test_one_shuffle_for_a_chain_of_entity_features(spark):
    from rankloom.operators import features as fe

    df = fe.add_rsi(fe.add_moving_average_features(fe.add_volume_features(fe.add_price_features(td.bars_d(spark, SF)))))
    # One for the bars (kdcode, dt), one by kdcode for all windows.
    assert plan(df).count("Exchange hashpartitioning") == 2


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 130


def test_wide_reshape_keeps_whole_first_bars(spark):
    from rankloom.sources import panel

    names = ["A|OPEN", "A|HIGH", "A|LOW", "A|CLOSE", "A|VOLUME", "B|CLOSE"]
    rows = [("2024-02-01", 1, 4.0, 9.0, 3.0, None, 7.0, 2.0), ("2024-02-01", 2, 1.0, 6.0, 1.0, 5.0, 8.0, 3.0), ("2024-02-01", 3, 0.5, 9.0, 0.5, 9.0, 9.0, None)]
    wide = spark.createDataFrame(rows, "dt string, seq int, " + ", ".join(f"`{n}` double" for n in names))
    got = {r.kdcode: r for r in panel.reshape_wide(wide).collect()}
    assert (got["A"].open, got["A"].close, got["A"].volume, got["A"].turnover) == (1.0, 5.0, 8.0, 40.0)
    assert (got["B"].open, got["B"].close) == (None, 2.0)
    with pytest.raises(ValueError, match="low"):
        panel.reshape_wide(wide.drop("A|LOW"))


def test_fingerprint_counts_repeats_and_places_of_nulls(spark):
    from rankloom.sources import panel

    def mark(rows):
        df = spark.createDataFrame(rows, "a int, b int").withColumn("dt", F.lit("2024-01-01").cast("date"))
        return panel.fingerprint(df).first().row_hash

    assert mark([(1, 1), (1, 1), (3, 3), (3, 3)]) != mark([(1, 1), (1, 1), (4, 4), (4, 4)])
    assert mark([(1, None)]) != mark([(None, 1)]) and mark([(1, 2), (3, 4)]) == mark([(3, 4), (1, 2)])


def test_snapshots_from_the_end_of_a_month(spark):
    from rankloom.operators import graph

    got = [str(r.valid_from) for r in graph.snapshot_dates(spark, "2023-12-31", "2024-06-29", 2).orderBy("valid_from").collect()]
    assert got == ["2023-12-31", "2024-02-29", "2024-04-29"] + ["2024-06-29"]
    assert [str(r.valid_from) for r in graph.snapshot_dates(spark, "2024-01-05", "2024-01-05", 3).collect()] == ["2024-01-05"]


def test_walkforward_over_a_configured_range(spark):
    from rankloom.operators import sequences as sq

    df = spark.createDataFrame([("2020-01-01",)], "d string").select(F.col("d").cast("date").alias("dt"))
    wf = sq.Walkforward(label_t=2, train_years=1, val_months=2, test_months=3, step_months=6)
    got = sq.walkforward_windows(df, wf, "2010-01-01", "2012-12-31").collect()
    assert got and all(str(r.test_end) <= "2012-12-31" for r in got)
    with pytest.raises(ValueError, match="fits"):
        sq.walkforward_windows(df, wf, "2010-01-01", "2010-06-30")
    with pytest.raises(ValueError, match="both"):
        sq.walkforward_windows(df, wf, "2010-01-01")


def test_series_with_two_rows_for_a_date_is_refused(spark):
    from rankloom.operators import clean

    day = F.lit("2024-01-02").cast("date").alias("dt")
    df, series = spark.range(2).select(F.col("id").alias("kdcode"), day), spark.range(2).select(day, F.col("id").alias("vix"))
    with pytest.raises(Exception, match="more than one row"):
        clean.join_series(df, series).collect()
    assert [r.vix for r in clean.join_series(df, series.limit(1)).collect()] == [0, 0]
