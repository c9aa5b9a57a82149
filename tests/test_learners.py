"""Grids of classifiers against the positions of one parameter set at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import learners
from tideline.operators import walkforward as w
from tideline.operators.ledger import LedgerOptions
from tideline.operators.search import classifier_rows, evaluate_classifiers, positions, run_search

BASE = {"lookback": 12, "forward": 3}
NB = [{**BASE, "var_smoothing": 1e-3}, {**BASE, "var_smoothing": 1e-1, "long_short": False, "signal_smooth": 5, "position_size": 0.5},
      {**BASE, "forward": 5, "var_smoothing": 1e-3, "retrain": False}]
KNN = [{**BASE, "n_neighbors": 5, "weights": "distance", "p": 1}, {**BASE, "n_neighbors": 3}, {**BASE, "n_neighbors": 39}]
OPTS = LedgerOptions(cost_bps=1, execution_lag=1)


@pytest.fixture(scope="module")
def long_walk(spark):
    """Two tickers of 340 bars, enough for every feature, and one of 60, which has no training rows."""
    rng, frames = np.random.default_rng(5), []
    for name, n in (("AAA", 340), ("BBB", 340), ("NEW", 60)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        frames.append(pd.DataFrame({"ticker": name, "date": pd.bdate_range("2020-01-01", periods=n).date, "open": close, "high": close * 1.01,
                                    "low": close * 0.99, "close": close, "volume": 1000.0}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf).withColumn("ann", F.lit(252.0)).cache(), pdf


@pytest.mark.parametrize("name,rows", [("ml_nb", NB), ("ml_knn", KNN[:2])])
def test_grid_equals_single_sets(long_walk, name, rows):
    bars, pdf = long_walk
    got = learners.grid_targets(bars, name, rows).toPandas()
    assert len(got) == len(pdf) * len(rows)
    for pid, row in enumerate(rows):
        one = positions(bars, name, **row).toPandas().sort_values(["ticker", "date"])
        mine = got[got["pid"] == pid].sort_values(["ticker", "date"])
        assert abs(one["target"].to_numpy() - mine["target"].to_numpy()).max() < 1e-12 and one["target"].abs().sum() > 0


def test_small_distance_blocks_change_nothing(long_walk, monkeypatch):
    bars, _ = long_walk
    opts = w.WalkOptions(12, 21, 3)
    data = w.labelled(bars, opts).cache()
    read = lambda: sorted(map(tuple, w.neighbour_grid(data, opts, [(5, "distance", 2), (9, "uniform", 1)]).collect()))
    want = read()
    monkeypatch.setattr(w, "PAIR_CELLS", 1)
    assert want and read() == want


def test_errors_are_rows_and_resume(long_walk):
    bars, _ = long_walk
    res = evaluate_classifiers(bars, "ml_knn", OPTS, KNN).collect()
    assert len(res) == 9
    for r in res:
        assert (r.error is not None) == (r.pid == 2) and (r.val_sharpe is None) == (r.pid == 2)
    done = bars.sparkSession.createDataFrame([(r.ticker, r.strategy, r.params) for r in res if r.pid < 2 and r.ticker == "AAA"], "ticker string, strategy string, params string")
    rest = run_search(bars, ["ml_knn"], OPTS, {"ml_knn": KNN}, done=done).select("ticker", "pid").collect()
    assert sorted(map(tuple, rest)) == [("AAA", 2), *[(t, i) for t in ("BBB", "NEW") for i in range(3)]]
    none = evaluate_classifiers(bars, "ml_knn", OPTS, KNN[2:]).select(F.count("error"), F.count("val_sharpe")).first()
    assert tuple(none) == (3, 0)


def test_spaces():
    assert len(classifier_rows("ml_nb")) == 3 * 3 * 8 * 2 * 2 * 2
    assert classifier_rows("ml_nb", {"lookback": [40]}, [0]) == [{"lookback": 40, "signal_smooth": 0}]
    with pytest.raises(ValueError):
        learners.completed("ml_nb", {"depth": 3})
