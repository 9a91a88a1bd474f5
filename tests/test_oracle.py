"""Registered queries against DuckDB. A subset by default; RANKLOOM_ALL=1 runs every key."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
SAMPLE = [
    "s3_series_shaping", "s9_wide_reshape", "s12_incremental_append", "c5_complete_in_every_split", "c9_point_in_time",
    "c12_asof_by_key", "f11_dynamic_weight", "f14_momentum_buffered", "g6_panel_regime", "n2_normalise",
    "n3_rank_positions", "l1_sliding_windows", "l7_panel_by_window", "e5_edge_attributes", "e6_lead_lag",
    "v8_newey_west", "v9_bootstrap_mean", "v11_quantile_returns", "k2_rank_scores", "b7_staggered_strategy",
    "b12_trade_journal", "p8_adjusted_p_values", "ta_target_portfolio", "m3_feature_drift", "x4_main_effects",
    "t1_stream_bars",
]
NAMES = list(entry.queries()) if os.environ.get("RANKLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "net_return" in df.columns
