import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import ranking as rk


@pytest.fixture(autouse=True, params=[rk.SLICE, 50])
def slices(request, monkeypatch):
    """As in production, where test groups are one slice, and with about fifty rows to a slice."""
    monkeypatch.setattr(rk, "SLICE", request.param)


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; one date holds more than a third and one value half of that date."""
    rng = np.random.default_rng(3)
    n = 20000
    dt = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    v = np.where((dt == 0) & (rng.random(n) < 0.5), 1.5, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"dt": dt, "kdcode": np.arange(n), "v": v})
    pdf.loc[pdf["kdcode"] % 50 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return pdf, df.repartition(13)


def test_row_numbers_hot_group(skewed):
    pdf, df = skewed
    got = rk.row_numbers(df, ["dt"], ["-v", "kdcode"]).toPandas().set_index("kdcode")["rank"]
    want = pdf.sort_values(["dt", "v", "kdcode"], ascending=[True, False, True]).groupby("dt").cumcount() + 1
    want.index = pdf.loc[want.index, "kdcode"]
    assert (got.sort_index() == want.sort_index()).all()


def test_ranks_of_several_columns_by_one_join(skewed):
    """Half of the largest group is one value of one column, and NULLs have no rank."""
    pdf, df = skewed
    both = df.withColumn("w", F.when(F.col("kdcode") % 3 > 0, 0.0).otherwise(F.col("kdcode") % 7))
    got = rk.percent_ranks(both, ["dt"], ["v", "w"], ["kdcode"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, (((dt#") == 1, plan
    rows = got.toPandas().set_index("kdcode").sort_index()
    pdf = pdf.assign(w=np.where(pdf["kdcode"] % 3 > 0, 0.0, pdf["kdcode"] % 7)).set_index("kdcode").sort_index()
    for c in ("v", "w"):
        np.testing.assert_allclose(rows[f"{c}_pct"].to_numpy(), pdf.groupby("dt")[c].rank(pct=True).to_numpy(), atol=1e-12)


def test_percent_ranks_of_groups(spark, skewed):
    """Ties, NULLs, NaN and both zeros rank as by the join of values."""
    pdf, df = skewed
    odd = F.when(F.col("kdcode") % 9 == 0, F.lit("NaN").cast("double")).when(F.col("kdcode") % 3 == 0, -0.0).when(F.col("kdcode") % 3 == 1, 0.0).otherwise(F.col("v"))
    both = df.withColumn("w", odd)
    assert rk.groups_fit(both, ["dt"]) == (rk.SLICE > 50)
    got = rk.percent_ranks_of_groups(both, ["dt"], ["v", "w"])
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    got = got.toPandas().set_index("kdcode").sort_index()
    want = rk.percent_ranks(both, ["dt"], ["v", "w"], ["kdcode"]).toPandas().set_index("kdcode").sort_index()
    assert got["v_pct"].isna().sum() == 400
    for c in ("v_pct", "w_pct"):
        np.testing.assert_array_equal(got[c].to_numpy(), want[c].to_numpy())


def test_percent_ranks_match_average_ties(skewed):
    pdf, df = skewed
    got = rk.percent_ranks(df, ["dt"], ["v"]).toPandas().set_index("kdcode")["v_pct"].sort_index()
    want = pdf.groupby("dt")["v"].rank(pct=True)
    want.index = pdf["kdcode"]
    np.testing.assert_allclose(got.to_numpy(), want.sort_index().to_numpy(), atol=1e-12)


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_exact_quantiles(skewed, accuracy):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = rk.exact_quantiles(df, ["dt"], "v", probs, accuracy).toPandas()
    for dt, g in got.groupby("dt"):
        want = np.quantile(pdf.loc[pdf["dt"] == dt, "v"].dropna(), probs)
        np.testing.assert_allclose(g.sort_values("q_index")["q"], want, atol=1e-12)


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_both_paths(skewed, k):
    pdf, df = skewed
    order = [F.col("v").desc_nulls_last(), F.col("kdcode").asc()]
    got = {tuple(r) for r in rk.top_k(df, ["dt"], order, k).select("dt", "kdcode", "rank").collect()}
    s = pdf.sort_values(["dt", "v", "kdcode"], ascending=[True, False, True])
    s["rank"] = s.groupby("dt").cumcount() + 1
    assert got == {tuple(map(int, r)) for r in s[s["rank"] <= k][["dt", "kdcode", "rank"]].to_numpy()}


def test_running_total_reports_group_total(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5)], "g string, o int, m int")
    got = sorted(tuple(r) for r in rk.running_total(df, ["g"], ["o"], F.col("m"), "t", total="n").collect())
    assert got == [("a", 1, 2, 5, 2), ("a", 2, 3, 5, 5), ("b", 1, 5, 5, 5)]


def test_rows_of_a_slice_carry_no_bounds(spark):
    """One group of 20,000 values: no row is joined to a list that grows with the group, and the rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(20000).selectExpr("0 AS g", "(id * 7919) % 20000 AS o").mapInArrow(noted, "g int, o bigint")
    got = rk.row_numbers(df, ["g"], ["o"], "k")
    assert got.where("k != o + 1").count() == 0 and got.count() == 20000
    assert made.value == 20000
    assert "_bounds" not in got._jdf.queryExecution().analyzed().toString()


def test_quantile_values_are_not_shuffled_to_their_brackets(spark, skewed, monkeypatch):
    """The brackets are few: their size must be known, so that no task sorts the values of a feature for a join."""
    plans = []
    monkeypatch.setattr(rk, "stable", lambda df, write=rk.stable: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        assert rk.exact_quantiles(skewed[1], ["dt"], "v", [0.5]).count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)
