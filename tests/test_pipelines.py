"""Search, bootstrap, exposure and file round trips on small fixtures."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import bootstrap as b
from tideline.operators import exposure as x
from tideline.operators import quality
from tideline.operators import selection as sel
from tideline.operators.ledger import LedgerOptions
from tideline.operators.search import development_bars, evaluate_grid, run_search, successive_halving
from tideline.operators.strategies import Strategy, _tsmom_panel, get_strategy, register
from tideline.operators.walkforward import WalkOptions
from tideline.sources import bars as src
from tideline.sources import sinks

GRID = {"lookback": [3, 5], "threshold": [0.0, 0.01], "long_short": [True, False], "skip_recent": [0]}
OPTS = LedgerOptions(execution_lag=1)


def test_chunks_and_lists_do_not_change_results(walk):
    bars, _ = walk
    dev = development_bars(bars, OPTS)
    key = lambda df: {(r.ticker, r.params): (r.val_sharpe, r.train_total_return, tuple(r.val_fold_sharpes)) for r in df.collect()}
    whole = key(evaluate_grid(dev, "tsmom", OPTS, GRID, [0, 3]))
    assert len(whole) == 2 * 8 * 2
    assert key(evaluate_grid(dev, "tsmom", OPTS, GRID, [0, 3], chunks=3)) == whole
    rows = [dict(zip(("lookback", "threshold", "long_short", "skip_recent", "signal_smooth"), c))
            for c in itertools.product([3, 5], [0.0, 0.01], [True, False], [0], [0, 3])]
    assert key(evaluate_grid(dev, "tsmom", OPTS, rows)) == whole


def test_positions_that_die_away_have_no_skewness(spark):
    """One early trade, smoothed: 160 bars later the returns are some 1e-80, and powers of their moments underflow to 0."""
    days = pd.bdate_range("2020-01-01", periods=400).date
    close = np.where(np.arange(400) < 8, 100 * 1.05 ** np.arange(400.0), 140 + 0.01 * (np.arange(400) * 7 % 5))
    bars = pd.DataFrame({"ticker": "A", "date": days, "open": close, "high": close, "low": close, "close": close, "volume": 1.0, "ann": 252.0})
    grid = {"lookback": [3], "threshold": [0.05], "long_short": [True], "skip_recent": [0]}
    rows = evaluate_grid(development_bars(spark.createDataFrame(bars), OPTS), "tsmom", OPTS, grid, [0, 2]).collect()
    assert len(rows) == 2 and all((r.error, r.val_skew, r.val_kurtosis, r.val_sharpe) == (None, 0.0, 0.0, -99.0) for r in rows)
    assert all(r.train_total_return > 0.1 and r.train_skew > 1 for r in rows)


def test_min_fee_search_uses_the_sequential_account(walk):
    bars, _ = walk
    o = LedgerOptions(execution_lag=1, min_fee=10.0)
    res = evaluate_grid(development_bars(bars, o), "tsmom", o, GRID, [0]).collect()
    assert len(res) == 16 and all(math.isfinite(r.val_sharpe) for r in res)


def test_halving_keeps_a_third_and_ends_on_everything(walk):
    bars, _ = walk
    rows = successive_halving(bars, ["tsmom"], OPTS, {"tsmom": GRID}, smooth=[0]).toPandas()
    counts = rows.groupby(["ticker", "stage"])["params"].count().unstack()
    assert (counts[0] == 8).all() and (counts[1] == 3).all() and (counts[2] == 1).all()
    assert (rows.groupby("ticker")["resource_bars"].max() == 60).all()
    final = rows[rows.stage == 2].set_index("ticker")
    full = run_search(bars, ["tsmom"], OPTS, {"tsmom": GRID}, smooth=[0]).toPandas().set_index(["ticker", "params"])
    for ticker, row in final.iterrows():
        assert row["val_sharpe"] == full.loc[(ticker, row["params"]), "val_sharpe"]


def test_user_defined_strategy(walk):
    bars, _ = walk
    register(Strategy("always_half", {"lookback": [3], "skip_recent": [0]}, ("lookback", "skip_recent"), _tsmom_panel,
                      lambda p: F.lit(0.5), defaults={"lookback": 3, "skip_recent": 0}, smooth=(0,)))
    res = evaluate_grid(development_bars(bars, OPTS), "always_half", OPTS).collect()
    assert {r.params for r in res} == {'{"lookback":3,"signal_smooth":0,"skip_recent":0}'}
    with pytest.raises(ValueError):
        get_strategy("nothing")


def test_overfitting_probability_by_hand(spark):
    folds = {"a": [1.0, 2.0, 3.0, 0.0], "b": [2.0, 1.0, 0.0, 3.0], "c": [0.5, 0.5, 0.5, 0.5]}
    df = spark.createDataFrame([("T", "s", n, f, 4) for n, f in folds.items()],
                               "ticker string, strategy string, params string, val_fold_sharpes array<double>, fold_count int")
    got = sel.overfitting_probability(df, 4).first()
    m, bad, n = np.array(list(folds.values())), 0, 0
    for inside in itertools.combinations(range(4), 2):
        outside = [i for i in range(4) if i not in inside]
        pick, out = int(np.argmax(m[:, inside].mean(axis=1))), m[:, outside].mean(axis=1)
        rank = (out < out[pick]).sum() + ((out == out[pick]).sum() + 1) / 2
        bad, n = bad + (math.log(rank / 4 / (1 - rank / 4)) <= 0), n + 1
    assert got.combinations == n and abs(got.pbo - bad / n) < 1e-12


def test_bootstrap_reproduces_direct_resampling(spark):
    rng = np.random.default_rng(0)
    n, opts = 97, b.BootstrapOptions(n_resamples=300, block_length=7, confidence_level=0.9, seed=11, draws="pcg64")
    s, m = rng.normal(0.001, 0.02, n), rng.normal(0.0005, 0.01, n)
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "date": pd.date_range("2020-01-01", periods=n).date, "strategy": s, "benchmark": m}))
    got = {r.statistic: r for r in b.bootstrap(df, ("key",), opts).collect()}
    blocks = math.ceil(n / 7)
    starts = np.random.Generator(np.random.PCG64(11)).integers(0, n, size=(300, blocks))
    idx = ((starts[:, :, None] + np.arange(7)) % n).reshape(300, -1)[:, :n]
    mean = s[idx].mean(axis=1) * 252
    sharpe = mean / (s[idx].std(axis=1, ddof=1) * math.sqrt(252))
    for name, values in (("strategy_annualized_mean", mean), ("strategy_sharpe", sharpe), ("annualized_mean_excess", (s - m)[idx].mean(axis=1) * 252)):
        lo, hi = np.quantile(values, [0.05, 0.95])
        assert abs(got[name].ci_low - lo) < 1e-9 and abs(got[name].ci_high - hi) < 1e-9 and got[name].status == "ok"


def test_bootstrap_statuses(spark):
    rows = [("short", i, 0.01 * (i % 3), 0.0) for i in range(20)] + [("flat", i, 0.001, 0.01 * (i * i % 37 % 11)) for i in range(100)]
    df = spark.createDataFrame([(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(s), float(m)) for k, i, s, m in rows], "key string, date date, strategy double, benchmark double")
    out = {(r.key, r.statistic): r.status for r in b.bootstrap(df, ("key",), b.BootstrapOptions(n_resamples=200)).collect()}
    assert out[("short", "strategy_sharpe")] == "insufficient_data"
    assert out[("flat", "strategy_sharpe")] == "zero_variance" and out[("flat", "benchmark_sharpe")] == "ok"
    with pytest.raises(ValueError):
        b.BootstrapOptions(n_resamples=100)


def test_recent_overlaps_by_brute_force(spark):
    rng, day = np.random.default_rng(5), dt.date(2000, 1, 1)
    obs = [(int(i), "T", day + dt.timedelta(int(a)), day + dt.timedelta(int(a + n))) for i, (a, n) in enumerate(zip(rng.integers(0, 300, 400), rng.integers(0, 120, 400)))]
    asks = [(int(i), "T", day + dt.timedelta(int(a)), day + dt.timedelta(int(a + n))) for i, (a, n) in enumerate(zip(rng.integers(0, 320, 40), rng.integers(0, 200, 40)))]
    o = spark.createDataFrame(obs, "event_id bigint, ticker string, start_date date, end_date date")
    c = spark.createDataFrame(asks, "claim_id bigint, ticker string, start_date date, end_date date")
    counts = {r.claim_id: r.prior_overlap_count for r in x.overlap_counts(c, o).collect()}
    newest = {}
    for r in x.recent_overlaps(c, o, 7).orderBy("claim_id", "position").collect():
        newest.setdefault(r.claim_id, []).append(r.event_id)
    for i, _, s, e in asks:
        hit = sorted((ev for ev, _, a, z in obs if a <= e and z >= s), reverse=True)
        assert counts[i] == len(hit) and newest.get(i, []) == hit[:7]


def test_csv_contract(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("Date, OPEN,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-03,1.5,2,1,1.25,\n")
    rows = src.read_ohlcv_csv(spark, str(good), "AAA").orderBy("date").collect()
    assert [r.close for r in rows] == [1.5, 1.25] and rows[1].volume is None
    for text in ("Date,Open,High,Low\n2020-01-02,1,2,3\n", "Date,Open,High,Low,Close,Extra\n2020-01-02,1,2,3,4,5\n", "Date,date,Open,High,Low,Close\n"):
        bad = tmp_path / f"b{abs(hash(text))}.csv"
        bad.write_text(text)
        with pytest.raises(src.BarContractError):
            src.read_ohlcv_csv(spark, str(bad), "AAA")
    for text in ("Date,Open,High,Low,Close\n02/01/2020,1,2,3,4\n", "Date,Open,High,Low,Close\n2020-01-02,1,x,3,4\n"):
        bad = tmp_path / f"c{abs(hash(text))}.csv"
        bad.write_text(text)
        with pytest.raises(Exception):
            src.read_ohlcv_csv(spark, str(bad), "AAA").collect()


def test_snapshot_is_never_overwritten(spark, walk, tmp_path):
    bars, _ = walk
    path = str(tmp_path / "snap")
    src.publish_snapshot(bars.drop("ann"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 300
    with pytest.raises(Exception):
        src.publish_snapshot(bars.drop("ann"), path)
    assert src.load_range(stored, "AAA", "2020-02-03", "2020-03-02").count() == 21
    with pytest.raises(src.BarContractError):
        src.load_range(stored, "AAA", "2020-02-03", "2031-01-01")


def test_results_store_and_exports(spark, walk, tmp_path):
    bars, _ = walk
    res = run_search(bars, ["tsmom"], OPTS, {"tsmom": GRID}, smooth=[0])
    path = str(tmp_path / "results")
    sinks.append_results(res.withColumn("val_sharpe", F.lit(-1.0)), path, "first")
    sinks.append_results(res, path, "second")
    back = sinks.read_results(spark, path)
    assert back.count() == 16 and back.filter("val_sharpe = -1").count() == 0
    sinks.export_results(back.drop("written_at"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 16
    one = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "a double, b double, c double")
    assert sinks.jsonable(one).first() == (None, None, 1.0)


def test_walk_options():
    for bad in (dict(forward=0), dict(embargo=-1), dict(step=0)):
        with pytest.raises(ValueError):
            WalkOptions(**bad)


def test_csv_folder_contract(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n")
    (folder / "b.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-03,1,2,0.5,1.5,\n")
    read = lambda: src.read_ohlcv_csv(spark, str(folder), "AAA").collect()
    assert len(read()) == 2
    for bad in ("2020-01-06,,2,0.5,1.5,1", "2020-01-06,-1,2,0.5,1.5,1", "2020-01-06,1,2,0.5,NaN,1", "2020-01-03,1,2,0.5,1.5,1", "06.01.2020,1,2,0.5,1.5,1", "2020-01-06,1,1,0.5,1.5,1"):
        (folder / "c.csv").write_text(f"Date,Open,High,Low,Close,Volume\n{bad}\n")
        with pytest.raises(Exception, match="bar contract broken"):
            read()
    (folder / "c.csv").write_text("Date,Close,High,Low,Open,Volume\n2020-01-06,1,2,0.5,1.5,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read()


def test_halving_resumes_from_stored_stages(walk):
    bars, _ = walk
    run = lambda **more: successive_halving(bars, ["tsmom"], OPTS, {"tsmom": GRID}, smooth=[0], **more)
    whole = run()
    again = run(done=whole.filter("stage < 2"))
    assert whole.exceptAll(again).count() == 0 and again.exceptAll(whole).count() == 0


def test_earlier_overlaps(spark):
    rng = np.random.default_rng(2)
    obs = [(int(i), "A" if i % 3 else "B", dt.date(2020, 1, 1) + dt.timedelta(int(a)), dt.date(2020, 1, 1) + dt.timedelta(int(a + n)))
           for i, a, n in zip(rng.permutation(300), rng.integers(-40000, 400, 300), rng.integers(0, 900, 300))]
    claims = [(int(i), "A" if i % 2 else "B", dt.date(2020, 1, 1) + dt.timedelta(int(a)), dt.date(2020, 1, 1) + dt.timedelta(int(a + n)))
              for i, a, n in zip(range(0, 300, 7), rng.integers(-40000, 400, 43), rng.integers(0, 20000, 43))]
    o = spark.createDataFrame(obs, "event_id bigint, ticker string, start_date date, end_date date")
    c = spark.createDataFrame(claims, "claim_id bigint, ticker string, start_date date, end_date date")
    want = {i: sum(e < i and t == u and s <= b and a <= f for e, u, s, f in obs) for i, t, a, b in claims}
    assert {r.claim_id: r.prior_overlap_count for r in x.earlier_overlap_counts(c, o).collect()} == want


def test_targets_out_of_reach_do_not_end_the_job():
    from tideline.operators.fills import CostCurve, solve_trades

    opts = LedgerOptions(impact_bps=5000, impact_exponent=1.0, cost_bps=5, min_fee=1.0)
    want = np.array([0.5, -3.0, 0.0, 0.9])
    asset, nav = np.array([0.0, -100.0, 40.0, 90.0]), np.full(4, 100.0)
    cost = CostCurve(np.array([1e6, 10.0, 1e6, 1e6]), np.zeros(4), opts)
    trade = solve_trades(asset, nav, want, cost)
    assert math.isclose((asset[0] + trade[0]) / (nav[0] - cost(np.abs(trade))[0]), 0.5, rel_tol=1e-12)
    assert trade[2] == -40.0 and np.isfinite(trade[[0, 2, 3]]).all()


def test_assets_without_a_known_calendar(spark):
    day = __import__("datetime").date
    assets = [("A", "exchange", "x"), ("B", "exchange", None), ("C", "exchange", "none"), ("D", "continuous", None)]
    meta = spark.createDataFrame([(t, c, i, day(2024, 1, 2), day(2024, 1, 5)) for t, c, i in assets], "ticker string, calendar string, calendar_id string, start date, end date")
    meta = meta.withColumns({"first_date": F.col("start"), "last_date": F.col("end")})
    days = spark.createDataFrame([("x", day(2024, 1, k), day(2024, 1, 1), day(2024, 1, 31)) for k in (2, 4)], "calendar_id string, date date, coverage_start date, coverage_end date")
    issues = {(r.code, r.severity, r.asset) for r in quality.calendar_issues(meta, days).collect()}
    assert issues == {("calendar_unverified", "warning", "B"), ("calendar_unverified", "warning", "C")}
    expected = sorted((r.ticker, r.date.day) for r in quality.expected_sessions(meta, days).collect())
    assert expected == [("A", 2), ("A", 4), ("D", 2), ("D", 3), ("D", 4), ("D", 5)]
