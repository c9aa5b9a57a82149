"""Keyed logistic regression and linear SVM against plain solvers and optimality conditions."""

import numpy as np
import pytest

from tideline.operators import linear
from tideline.operators import walkforward as w

NAMES = ("ret_1", "ret_5", "ma_dist_5", "rsi_7", "vol_10", "range_10")
OPTS = w.WalkOptions(train_size=30, step=21, forward=3)


@pytest.fixture(scope="module")
def sets(spark, walk):
    bars, _ = walk
    data = w.labelled(bars, OPTS, NAMES).cache()
    rows = data.toPandas()
    return data, {t: d.sort_values("_seq") for t, d in rows.groupby("ticker")}


def training(sets, model):
    d = sets[model.ticker]
    d = d[d["x"].notna() & d["label"].notna() & (d["_seq"] <= model.cut)]
    x, y = np.stack(d["x"].to_numpy()), np.where(d["label"].to_numpy() == 1, 1.0, -1.0)
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd), y


def newton(z, y, C):
    a, v = np.column_stack([z, np.ones(len(z))]), np.zeros(z.shape[1] + 1)
    ridge = np.append(np.ones(z.shape[1]), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(y * (a @ v)))
        v -= np.linalg.solve(C * (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge) + 1e-12 * np.eye(len(v)), -C * (y * p) @ a + ridge * v)
    return v


@pytest.mark.parametrize("C", [0.01, 1.0, 50.0])
def test_logistic_l2(sets, C):
    data, by = sets
    models = linear.fit_linear(data, OPTS, C, "l2", width=len(NAMES)).collect()
    assert len(models) == w.fold_table(data, OPTS).where("fitted").count() and all(m.settled for m in models)
    for m in models:
        assert np.abs(newton(*training(by, m), C) - [*m.coef, m.intercept]).max() < 1e-5


@pytest.mark.parametrize("C", [0.1, 5.0])
def test_logistic_l1_conditions(sets, C):
    data, by = sets
    zeros = 0
    for m in linear.fit_linear(data, OPTS, C, "l1", width=len(NAMES)).collect():
        z, y = training(by, m)
        v = np.array(m.coef)
        p = 1 / (1 + np.exp(y * (z @ v + m.intercept)))
        pull = C * (y * p) @ z
        assert m.settled and abs(C * (y * p).sum()) < 1e-3
        assert (np.abs(pull[v == 0]) <= 1 + 1e-3).all() and (np.abs(pull[v != 0] - np.sign(v[v != 0])) < 1e-3).all()
        zeros += (v == 0).sum()
    assert zeros


def hinge_minimum(z, y, C, rounds=4000):
    """Dual by pairwise ascent, most violating pair first, as the definition of the machine has it; the best primal value met."""
    k, alpha = z @ z.T, np.zeros(len(y))
    grad = -np.ones(len(y))
    for _ in range(rounds):
        up = np.where((y > 0) & (alpha < C) | (y < 0) & (alpha > 0), -y * grad, -np.inf)
        low = np.where((y > 0) & (alpha > 0) | (y < 0) & (alpha < C), -y * grad, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < 1e-10:
            break
        t = (up[i] - low[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min(t, C - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else C - alpha[j])
        alpha[i] += y[i] * t
        alpha[j] -= y[j] * t
        grad += t * y * (k[:, i] - k[:, j])
    v = (alpha * y) @ z
    b = (up.max() + low.min()) / 2
    return alpha.sum() - 0.5 * v @ v, 0.5 * v @ v + C * np.maximum(0, 1 - y * (z @ v + b)).sum()


@pytest.mark.parametrize("C", [0.1, 5.0])
def test_svm_reaches_the_hinge_minimum(sets, C):
    data, by = sets
    for m in linear.fit_linear(data, OPTS, C, "l2", "hinge", len(NAMES)).collect():
        z, y = training(by, m)
        v = np.array(m.coef)
        primal = 0.5 * v @ v + C * np.maximum(0, 1 - y * (z @ v + m.intercept)).sum()
        dual, other = hinge_minimum(z, y, C, 200_000)
        assert m.settled and primal <= other * (1 + 1e-6) and primal - dual <= 1e-6 * max(1.0, primal)


def test_predictions_and_first_fold_only(sets, walk):
    data, by = sets
    models = linear.fit_linear(data, OPTS, 1.0, width=len(NAMES))
    got = linear.linear_predictions(data, OPTS, models, len(NAMES)).collect()
    assert len(got) == w.prediction_rows(data, OPTS).count()
    coef = {(m.ticker, m.fold): m for m in models.collect()}
    for r in got:
        m = coef[(r.ticker, r.fold)]
        d = by[r.ticker]
        x = np.array(d.loc[d["date"] == r.date, "x"].iloc[0])
        score = (x - m.mean) / m.std @ np.array(m.coef) + m.intercept
        assert abs(score - r.score) < 1e-9 and r.pred == int(r.score > 0)
    once = w.WalkOptions(train_size=30, step=21, forward=3, retrain=False)
    assert linear.fit_linear(data, once, 1.0, width=len(NAMES)).count() == 2
    assert linear.logistic_regression(data.limit(0), OPTS, width=len(NAMES)).count() == 0
    with pytest.raises(ValueError):
        linear.fit_linear(data, OPTS, penalty="l3")
