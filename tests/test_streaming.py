import datetime as dt
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import portfolio as po
from rankloom.operators.ledger import performance_ledger
from rankloom.plans import catalog, testdata
from rankloom.session import new_path
from rankloom.sources.bars import bars_from_ticks
from rankloom.streaming import jobs
from rankloom.streaming.versions import Store


def test_stream_bars_equal_batch_for_closed_days(spark):
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    rows = [(int(rng.integers(3)), start + dt.timedelta(hours=float(h)), float(rng.random()), i) for i, h in enumerate(sorted(rng.random(400) * 240))]
    ticks = spark.createDataFrame(rows, "kdcode bigint, ts timestamp, value double, event_id bigint")
    src = new_path(spark, "ticks")
    ticks.write.parquet(src)
    got = jobs.run_to_table(jobs.daily_bars(jobs.read_files(spark, src, ticks)), new_path(spark, "bars"))
    batch = bars_from_ticks(ticks.withColumn("dt", F.to_date("ts")), ["kdcode", "dt"], "value", "value", "event_id")
    last = max(r[1] for r in rows) - dt.timedelta(days=1)
    closed = batch.where(F.date_add("dt", 1).cast("timestamp") <= F.lit(last))
    cols = ["kdcode", "dt", "open", "high", "low", "close"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, closed.select(*cols).collect()))


PANEL = "kdcode bigint, dt date, close double, seq int"


def panel_rows(spark, path, schema):
    return sorted((r.kdcode, r.close) for r in jobs.panel_of(spark, path, schema).collect())


def test_append_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 5), 1.0, 0), (1, dt.date(2024, 1, 5), 2.0, 1), (2, dt.date(2024, 2, 5), 3.0, 0)], PANEL)
    path = new_path(spark, "panel")
    assert [jobs.upsert(df, path, ["kdcode", "dt"], "seq") for _ in range(2)] == [True, False]
    late = spark.createDataFrame([(1, dt.date(2024, 1, 5), 9.0, 0), (3, None, 4.0, 0)], df.schema)
    assert jobs.upsert(late, path, ["kdcode", "dt"], "seq")
    assert panel_rows(spark, path, df.schema) == [(1, 2.0), (2, 3.0), (3, 4.0)]
    assert not jobs.upsert(df.limit(0), path, ["kdcode", "dt"], "seq")
    assert Store(spark, path).version == 1


def test_append_that_dies_before_the_commit(spark, monkeypatch):
    """The month written half-way is not seen, the batch can be repeated, and a frame read before stays as it was."""
    first = spark.createDataFrame([(1, dt.date(2024, 1, 5), 1.0, 0), (2, dt.date(2024, 2, 5), 3.0, 0)], PANEL)
    second = spark.createDataFrame([(1, dt.date(2024, 1, 6), 5.0, 0), (2, dt.date(2024, 2, 5), 7.0, 1)], PANEL)
    path = new_path(spark, "panel")
    jobs.upsert(first, path, ["kdcode", "dt"], "seq")
    seen = jobs.panel_of(spark, path, first.schema)
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.upsert(second, path, ["kdcode", "dt"], "seq")
    assert panel_rows(spark, path, first.schema) == [(1, 1.0), (2, 3.0)]
    bad = second.withColumn("close", F.when(F.col("kdcode") == 2, F.expr("raise_error('lost')").cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):  # a task fails
        jobs.upsert(bad, path, ["kdcode", "dt"], "seq")
    store = Store(spark, path)
    with pytest.raises(Exception, match="lost"):  # a task fails while months are written
        store.stage("panel", bad, ["2024-01", "2024-02"])
    assert panel_rows(spark, path, first.schema) == [(1, 1.0), (2, 3.0)]
    for _ in range(2):
        jobs.upsert(second, path, ["kdcode", "dt"], "seq")
    want = [(1, 1.0), (1, 5.0), (2, 7.0)]
    assert panel_rows(spark, path, first.schema) == want
    assert sorted((r.kdcode, r.close) for r in seen.collect()) == [(1, 1.0), (2, 3.0)]
    store = Store(spark, path)
    assert store.version == 1 and store.vacuum(keep=1) == 2 and store.vacuum(keep=1) == 0
    assert panel_rows(spark, path, first.schema) == want


def test_two_writers_do_not_overwrite_each_other(spark):
    path = new_path(spark, "store")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 5), 1.0, 0)], PANEL)
    a, b = Store(spark, path), Store(spark, path)
    for s in (a, b):
        s.stage("panel", df, ["2024-01"])
    a.commit()
    with pytest.raises(RuntimeError, match="someone else"):
        b.commit()
    with pytest.raises(ValueError, match="not announced"):
        a.stage("panel", df, ["2024-02"])
    assert Store(spark, path).read("panel", df.schema, since="2024-02").count() == 0


DAILY = "strategy_id int, dt date, portfolio_return double, benchmark_return double, turnover double, num_trades bigint, num_holdings bigint, seq int"


def daily_returns(seed, months=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in (1, 2):
        for k in range(months * 8):
            d = dt.date(2024, 1 + k // 8, 1 + 3 * (k % 8))
            if rng.random() < 0.8:
                rows.append((s, d, float(rng.normal() * 0.6), None if rng.random() < 0.1 else float(rng.normal() * 0.01), float(rng.random()), int(rng.integers(9)), 5, 1))
    return rows


def ledger_rows(df):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_ledger_from_months_equals_the_whole_ledger(spark):
    """In any order of arrival, with stale and repeated rows, gains below minus one, and a null return at the start."""
    rows = daily_returns(3) + [(3, dt.date(2024, 1, 1), None, None, 0.1, 1, 5, 1), (3, dt.date(2024, 3, 1), 0.5, 0.1, 0.1, 1, 5, 1), (3, dt.date(2024, 4, 1), -2.5, 0.1, 0.1, 1, 5, 1)]
    rows += [(3, dt.date(2024, 4, 2), -0.5, 0.1, 0.1, 1, 5, 1), (3, dt.date(2024, 5, 2), -3.0, 0.1, 0.1, 1, 5, 1)]
    stale = [(*r[:2], 0.9, *r[3:7], 0) for r in rows[::3]]
    path = new_path(spark, "ledger")
    batches = [[r for r in rows if r[1].month in (3, 5)], stale, [r for r in rows if r[1].month in (1, 2, 4)], rows[::2], []]
    changed = [jobs.update_ledger(spark.createDataFrame(b, DAILY), path) for b in batches]
    assert changed == [True, True, True, False, False]
    whole = spark.createDataFrame(rows, DAILY)
    want = ledger_rows(performance_ledger(whole, digits=None))
    assert ledger_rows(jobs.ledger_of(spark, path, whole.schema, digits=None)) == want
    late = jobs.ledger_of(spark, path, whole.schema, digits=None, since="2024-04")
    assert ledger_rows(late) == [r for r in want if r[1] >= dt.date(2024, 4, 1)]


def test_ledger_update_reads_touched_months_only(spark):
    rows = daily_returns(4)
    whole = spark.createDataFrame(rows, DAILY)
    path = new_path(spark, "ledger")
    jobs.update_ledger(whole.where("month(dt) <= 4"), path)
    store = Store(spark, f"{path}/ledger")
    for table in ("daily", "local"):  # an update that looked at these would fail
        for month in ("2024-01", "2024-03"):
            shutil.rmtree(f"{store.path}/{store.months[table][month]}")
    jobs.update_ledger(whole.where("month(dt) = 5"), path)
    jobs.update_ledger(whole.where("month(dt) = 2").withColumn("portfolio_return", F.lit(0.25)).withColumn("seq", F.lit(2)), path)
    changed = whole.withColumn("portfolio_return", F.when(F.month("dt") == 2, 0.25).otherwise(F.col("portfolio_return")))
    want = [r for r in ledger_rows(performance_ledger(changed, digits=None)) if r[1].month >= 4]
    assert ledger_rows(jobs.ledger_of(spark, path, whole.schema, digits=None, since="2024-04")) == want


def loop_gate(rows, s):
    """Names held by (day) of one strategy by the rule, day by day."""
    held, prev, out = None, {}, {}
    mine = [r for r in rows if r[0] == s.model_id]
    for d in sorted({r[1] for r in mine}):
        order = [k for _, k in sorted((-v, k) for _, x, k, v in mine if x == d)]
        rank = {k: i + 1 for i, k in enumerate(order)}
        if held is None:
            new = set(order[: s.top_k])
        else:
            stay = [k for k in held if k in rank and not (k in prev and rank[k] - prev[k] >= s.min_rank_drop)]
            new = set(stay + [k for k in order if k not in stay][: s.top_k - len(stay)])
        held, prev = new, rank
        out[d] = new
    return out


def gate_scores(seed, models, code=int, days=16, names=22):
    rng = np.random.default_rng(seed)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(days)]
    rows = []
    for m in models:
        level = rng.normal(size=names)
        for d in dates:
            level = level * 0.8 + rng.normal(size=names)
            rows += [(m, d, code(k), float(level[k])) for k in range(names) if rng.random() < 0.9]
    return dates, rows


@pytest.mark.parametrize("case", ["one file", "late model", "replayed and empty", "split dates", "late dates", "changed scores", "string codes"])
def test_stream_gate_equals_day_loop(spark, case):
    code = (lambda k: f"N{k:02d}.X") if case == "string codes" else int
    dates, rows = gate_scores(11, (1, 2), code)
    quarter = [set(x.tolist()) for x in np.array_split(np.arange(len(dates)), 4)]
    part = lambda keep, models=(1, 2): [r for r in rows if dates.index(r[1]) in keep and r[0] in models]
    number = lambda r: int(str(r[2]).strip("N.X"))
    files = {
        "one file": [rows],
        "late model": [part(range(9), (1,)), part(range(9), (2,)), part(range(9, 16))],
        "split dates": [[r for r in part(q) if (number(r) + r[0]) % 2 == half] for q in (quarter[0], quarter[1] | quarter[2] | quarter[3]) for half in (0, 1)],
        "late dates": [part(range(8, 16)), part(range(4)) + part(range(4, 8), (1,)), [r for r in part(range(4, 8), (2,)) if number(r) < 11], [r for r in part(range(4, 8), (2,)) if number(r) >= 11]],
        "changed scores": [[(*r[:3], -r[3]) for r in part(range(10))], part(range(5, 16)), part(range(6))],
        "replayed and empty": [part(range(4)), part(range(4)), part(range(4, 10)), part(range(2, 10)), [], part(range(10, 16))],
    }.get(case, [part(q) for q in quarter])
    src = new_path(spark, "scores")
    schema = f"model_id int, dt date, kdcode {'string' if case == 'string codes' else 'bigint'}, score double"
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(src)
    strategies = [po.Strategy(1, 1, 3, 1, "daily", 0, 0, 4), po.Strategy(2, 1, 5, 1, "daily", 0, 0, 8), po.Strategy(3, 2, 4, 1, "daily", 0, 0, 5)]
    stream = jobs.read_files(spark, src, spark.read.parquet(src), files_per_batch=1)
    out = jobs.run_gate(stream, po.strategies_frame(spark, strategies), new_path(spark, "gate")).collect()
    for s in strategies:
        for d, want in loop_gate(rows, s).items():
            got = [r.kdcode for r in out if r.strategy_id == s.strategy_id and r.dt == d and r.status != "exit"]
            assert len(got) == len(set(got)) and set(got) == want, (s.strategy_id, d)
    assert {(r.strategy_id, r.dt) for r in out} == {(s.strategy_id, d) for s in strategies for d in loop_gate(rows, s)}


def test_gate_batch_that_dies_is_repeated_from_the_state_before(spark, monkeypatch):
    dates, rows = gate_scores(12, (1,))
    schema = "model_id int, dt date, kdcode bigint, score double"
    strategies = po.strategies_frame(spark, [po.Strategy(1, 1, 3, 1, "daily", 0, 0, 4)])
    path = new_path(spark, "gate")
    first, second = (spark.createDataFrame([r for r in rows if (r[1] < dates[8]) == early], schema) for early in (True, False))
    jobs.update_gate(first, strategies, path, 0)
    before = jobs.gate_decisions(spark, path, strategies, first.schema).count()
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.update_gate(second, strategies, path, 1)
    assert jobs.gate_decisions(spark, path, strategies, first.schema).count() == before
    assert jobs.update_gate(second, strategies, path, 1) and not jobs.update_gate(second, strategies, path, 1)
    out = jobs.gate_decisions(spark, path, strategies, first.schema).where("status <> 'exit'").collect()
    want = loop_gate(rows, po.Strategy(1, 1, 3, 1, "daily", 0, 0, 4))
    assert {d: {r.kdcode for r in out if r.dt == d} for d in want} == want


def test_gate_ranks_only_models_that_a_strategy_follows(spark, monkeypatch):
    """Their scores are stored all the same, and the decisions of others stay."""
    dates, rows = gate_scores(13, (1, 2), days=6)
    seen = []
    ranks = jobs.rank_scores
    monkeypatch.setattr(jobs, "rank_scores", lambda s: seen.append({r.model_id for r in s.select("model_id").distinct().collect()}) or ranks(s))
    schema = "model_id int, dt date, kdcode bigint, score double"
    s = po.Strategy(1, 1, 3, 1, "daily", 0, 0, 4)
    path, strategies = new_path(spark, "gate"), po.strategies_frame(spark, [s])
    both, late = [r for r in rows if r[0] == 1 or r[1] > dates[2]], [r for r in rows if r[0] == 2 and r[1] <= dates[2]]
    batches = [spark.createDataFrame(b, schema) for b in (both, late)]
    assert [jobs.update_gate(b, strategies, path, n) for n, b in enumerate([*batches, batches[1]])] == [True, True, False]
    assert seen == [{1}]
    assert Store(spark, f"{path}/gate").read("scores", batches[0].schema).count() == len(rows)
    out = jobs.gate_decisions(spark, path, strategies, batches[0].schema).where("status <> 'exit'").collect()
    want = loop_gate(rows, s)
    assert {d: {r.kdcode for r in out if r.dt == d} for d in want} == want


def test_stream_gate_query_computes_the_scores_once(spark, monkeypatch):
    """Each arrival is taken from the written scores, by any number of tasks, and is one batch."""
    seen, batches = spark.sparkContext.accumulator(0), []
    scores, update = testdata.scores, jobs.update_gate

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    monkeypatch.setattr(testdata, "scores", lambda *a: (lambda s: s.mapInPandas(counted, s.schema))(scores(*a)))
    monkeypatch.setattr(jobs, "update_gate", lambda b, *a: batches.append(b.count()) or update(b, *a))
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["t5_stream_gate"](spark, sf).count() > 0
    n = scores(spark, sf).count()
    assert seen.value == n and len(batches) == 5 and sum(batches) == n
