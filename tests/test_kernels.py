import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import kernels as k
from tideline.functions.normal import normal_cdf, normal_quantile
from tideline.operators import grid as g
from tideline.operators.strategies import STRATEGIES
from tideline.operators.walkforward import ML_GRIDS, ML_SMOOTH, knn_valid


@pytest.mark.parametrize("lead", [0, 5])
def test_ewm_equals_pandas(spark, lead):
    rng = np.random.default_rng(lead)
    x = rng.normal(50, 5, 400)
    x[:lead] = np.nan
    pdf = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=400).date, "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    spans = (1, 2, 12, 64, 250)
    out = k.with_ewm(df, [("x", k.span_alpha(s), f"e{s}") for s in spans]).orderBy("date").toPandas()
    for s in spans:
        want = pd.Series(x).ewm(span=s, adjust=False).mean()
        np.testing.assert_allclose(out[f"e{s}"].astype(float), want, rtol=1e-12, atol=1e-12)


def test_ewm_over_many_chapters(spark):
    """30,000 rows of one key reach over seven chapters; a second key stays short. No window collects more than a chapter."""
    rng = np.random.default_rng(7)
    x = {"A": np.cumsum(rng.normal(0, 1, 30_000)), "B": rng.normal(0, 1, 70)}
    pdf = pd.concat([pd.DataFrame({"ticker": t, "n": range(len(v)), "x": v}) for t, v in x.items()])
    df = spark.createDataFrame(pdf).withColumn("date", F.date_add(F.lit("1950-01-01"), F.col("n").cast("int")))
    spans = (12, 200, 2500, 60_000)
    df = k.with_ewm(df, [("x", k.span_alpha(s), f"e{s}") for s in spans])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("_chap" in part.split("windowspecdefinition(")[1].split("ASC")[0] for part in plan.split("collect_list(")[1:])
    out = df.orderBy("ticker", "n").toPandas()
    for s in spans:
        for t, v in x.items():
            np.testing.assert_allclose(out.loc[out.ticker == t, f"e{s}"], pd.Series(v).ewm(span=s, adjust=False).mean(), rtol=1e-10, atol=1e-10)


def test_ewm_of_a_constant_is_exact(spark):
    df = spark.range(200).select(F.lit("A").alias("ticker"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"), F.lit(3.7).alias("x"))
    row = k.with_ewm(df, [("x", 0.1, "e")]).agg(F.min("e"), F.max("e")).first()
    assert row[0] == row[1] == 3.7


def test_normal_distribution(spark):
    n = NormalDist()
    z = [-9.0, -7.5, -3.2, -1.0, -1e-3, 0.0, 0.4, 2.5, 6.9, 8.1]
    p = [1e-12, 1e-6, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(a, b) for a, b in zip(z + [0.0] * 10, p + [0.5] * 12)], "z double, p double")
    for row in df.select("z", "p", normal_cdf(F.col("z")).alias("c"), normal_quantile(F.col("p")).alias("q")).collect():
        assert math.isclose(row.c, n.cdf(row.z), rel_tol=1e-9, abs_tol=1e-15)
        assert math.isclose(row.q, n.inv_cdf(row.p), rel_tol=1e-12, abs_tol=1e-12)


def test_search_space_sizes():
    sizes = {"tsmom": 11760, "ma_cross": 3840, "macd": 12180, "rsi": 47960, "roc": 4480, "bollinger": 3360, "donchian": 2730,
             "dual_momentum": 1620, "triple_ma": 3420, "vol_scale_mom": 14580, "acceleration": 4410, "zscore": 7400, "heikin_ashi": 180,
             "supertrend": 560, "multi_breakout": 500, "ensemble": 560, "stacked": 38400, "regime_aware": 1728}
    count = lambda grid, valid, smooth: len(smooth) * sum(1 for _ in g.combinations(grid, list(grid), valid))
    assert {n: count(s.grid, s.params_valid, s.smooth) for n, s in STRATEGIES.items() if n in sizes} == sizes
    ml = {"ml_logreg": 1920, "ml_rf": 12960, "ml_xgb": 90720, "ml_knn": 2304, "ml_nb": 576, "ml_svm": 252}
    assert {n: count(grid, knn_valid if n == "ml_knn" else None, ML_SMOOTH) for n, grid in ML_GRIDS.items()} == ml


def test_grid_rows_and_identity(spark):
    grid = {"b": [0.0, 0.0005], "a": [1, 2], "t": [(1, 2), (3,)], "f": [True, False]}
    rows = g.build_grid(spark, grid, lambda p: p["a"] < 2).collect()
    assert len(rows) == 8 and len({r.pid for r in rows}) == 8
    assert g.canonical({"b": 0.0005, "a": 1, "t": (1, 2), "f": True}) in {r.params for r in rows}


def test_quick_sample_is_distinct_valid_and_repeatable(spark):
    s = STRATEGIES["ma_cross"]
    full = s.full_grid()
    draw = lambda: g.quick_sample(g.build_grid(spark, full, s.valid), full, 5, "ma_cross").collect()
    a, b = draw(), draw()
    assert [r.params for r in a] == [r.params for r in b] and len({r.params for r in a}) == 5
    assert all(r.fast < r.slow for r in a)
    assert g.quick_sample(g.build_grid(spark, {"x": [1, 2]}), {"x": [1, 2]}, 5).count() == 2


def test_neighbours(spark):
    one = spark.createDataFrame([(10, 0.5, 0, 2)], "lookback bigint, threshold double, skip bigint, tiny bigint")
    kinds = {"lookback": "int", "threshold": "double", "skip": "int", "tiny": "int"}
    got = {(r["moved"], r[r["moved"]]) for r in g.neighbour_rows(one, kinds).collect()}
    assert got == {("lookback", 8), ("lookback", 12), ("threshold", 0.4), ("threshold", 0.6), ("skip", 1), ("tiny", 1), ("tiny", 3)}
