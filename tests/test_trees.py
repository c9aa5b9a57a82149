"""Keyed forests and boosted trees against plain recursive ones that draw the same numbers."""

import numpy as np
import pytest

from tideline.operators import trees
from tideline.operators import walkforward as w

NAMES = ("ret_1", "ret_5", "ma_dist_5", "rsi_7", "vol_10", "range_10")
OPTS = w.WalkOptions(train_size=30, step=21, forward=3)


@pytest.fixture(scope="module")
def sets(spark, walk):
    bars, _ = walk
    data = w.labelled(bars, OPTS, NAMES).cache()
    return data, {t: d.sort_values("_seq") for t, d in data.toPandas().groupby("ticker")}


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 16 rows, so that a histogram is added up from many."""
    monkeypatch.setattr(trees, "BLOCK_ROWS", 16)


def training(sets, ticker, cut):
    d = sets[ticker]
    d = d[d["x"].notna() & d["label"].notna() & (d["_seq"] <= cut)]
    return np.stack(d["x"].to_numpy()), d["label"].to_numpy().astype(int), d["_seq"].to_numpy().astype(int)


def plain_tree(x, rows, n, s, features_of, score_of, may_split, middle, node=1, depth=0, scale=1.0):
    """{node: (value sums, feature, threshold)} by trying every cut between neighbouring values of the training set."""
    tn, ts = n[rows].sum(), s[rows].sum()
    out = {node: (len(rows), tn / scale, ts / scale, None, None)}
    if not may_split(len(rows), tn, ts, depth):
        return out
    best = None
    for f in features_of(node):
        for t in middle[f]:
            left = x[rows, f] <= t
            if left.all() or not left.any():
                continue
            ln, ls = n[rows][left].sum() / scale, s[rows][left].sum() / scale
            got = score_of(ln, ls, (tn - n[rows][left].sum()) / scale, (ts - s[rows][left].sum()) / scale, tn / scale, ts / scale)
            if got is not None and (best is None or got > best[0]):
                best = (got, f, t, left)
    if best is None:
        return out
    _, f, t, left = best
    out[node] = (*out[node][:3], f, t)
    for child, side in ((2 * node, left), (2 * node + 1, ~left)):
        out |= plain_tree(x, rows[side], n, s, features_of, score_of, may_split, middle, child, depth + 1, scale)
    return out


def middles(x):
    return [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]


def by_model(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault((r.ticker, r.fold, r.cut), {}).setdefault(r.tree, {})[r.node] = r
    return out


def leaf(tree, row):
    at = 1
    while tree[at].feature is not None:
        at = 2 * at + int(row[tree[at].feature] > tree[at].threshold)
    return tree[at].value


def gini(ln, ls, rn, rs, tn, ts):
    return (ls * ls + (ln - ls) * (ln - ls)) / ln + (rs * rs + (rn - rs) * (rn - rs)) / rn


@pytest.mark.parametrize("depth,split,features", [(2, 2, "sqrt"), (None, 25, None)])
def test_forest_tree_by_tree(sets, small_blocks, depth, split, features):
    data, by = sets
    take = {"sqrt": 2, None: 6}[features]
    models = by_model(trees.fit_forest(data, OPTS, 3, depth, split, features, width=len(NAMES)))
    assert len(models) == w.fold_table(data, OPTS).where("fitted").count() > 4
    for (ticker, _, cut), found in models.items():
        x, y, seq = training(by, ticker, cut)
        assert sorted(found) == [0, 1, 2]
        for t, nodes in found.items():
            n = trees.copies(t, seq)
            want = plain_tree(x, np.flatnonzero(n), n, n * y, lambda node: trees.drawn(t, [node], len(NAMES), take)[0], gini,  # noqa: B023
                              lambda rows, tn, ts, d: rows >= split and 0 < ts < tn and (depth is None or d < depth), middles(x))
            assert sorted(nodes) == sorted(want)
            for i, (rows, tn, ts, f, cut_at) in want.items():
                assert (nodes[i].rows, nodes[i].value, nodes[i].feature) == (rows, ts / tn, f)
                assert cut_at is None or abs(nodes[i].threshold - cut_at) < 1e-12


def second_order(ln, ls, rn, rs, tn, ts):
    got = ls * ls / (ln + 1) + rs * rs / (rn + 1) - ts * ts / (tn + 1)
    return got if ln >= 1 and rn >= 1 and got > 1e-6 else None


@pytest.mark.parametrize("share,columns", [(1.0, 1.0), (0.7, 0.5)])
def test_boosting_tree_by_tree(sets, small_blocks, share, columns):
    data, by = sets
    take = int(columns * len(NAMES))
    models = by_model(trees.fit_boosted(data, OPTS, 2, 2, 0.3, share, columns, width=len(NAMES)))
    for (ticker, _, cut), found in models.items():
        x, y, seq = training(by, ticker, cut)
        margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        assert abs(found[-1][1].value - margin[0]) < 1e-12
        for t in range(2):
            p = 1 / (1 + np.exp(-margin))
            h, g = np.rint(p * (1 - p) * trees.FINE), np.rint((p - y) * trees.FINE)
            rows = np.flatnonzero(trees.uniform(2, t, seq) < share)
            want = plain_tree(x, rows, h, g, lambda node: trees.drawn(t, [0], len(NAMES), take)[0], second_order,  # noqa: B023
                              lambda k, tn, ts, d: k >= 2 and d < 2, middles(x), scale=trees.FINE)
            assert sorted(found[t]) == sorted(want)
            for i, (k, tn, ts, f, _) in want.items():
                assert found[t][i].rows == k and found[t][i].feature == f and abs(found[t][i].value + 0.3 * ts / (tn + 1)) < 1e-9
            margin = margin + [leaf(found[t], row) for row in x]


def test_predictions(sets):
    data, by = sets
    nodes = trees.fit_forest(data, OPTS, 20, 3, width=len(NAMES)).cache()
    models = {k[:2]: v for k, v in by_model(nodes).items()}
    got = trees.tree_scores(data, OPTS, nodes).collect()
    assert len(got) == w.prediction_rows(data, OPTS).count()
    for r in got:
        d = by[r.ticker]
        x = d.loc[d["date"] == r.date, "x"].iloc[0]
        assert r.trees == 20 and abs(r.total - sum(leaf(t, x) for t in models[(r.ticker, r.fold)].values())) < 1e-9


def test_first_fold_only_bins_and_empty(sets):
    data, _ = sets
    once = w.WalkOptions(train_size=30, step=21, forward=3, retrain=False)
    rows = trees.random_forest(data, once, len(NAMES), n_estimators=3, max_depth=2)
    assert rows.count() == w.prediction_rows(data, once).count() and {r.pred for r in rows.collect()} <= {0, 1}
    few = trees.fit_forest(data, once, 3, 2, bins=4, width=len(NAMES)).where("feature is not null")
    assert 0 < few.select("ticker", "fold", "feature", "threshold").distinct().count() <= 2 * 3 * len(NAMES)
    assert trees.random_forest(data.limit(0), OPTS, len(NAMES), n_estimators=2, max_depth=2).count() == 0
    assert trees.boosted_trees(data.limit(0), OPTS, len(NAMES), n_estimators=2, max_depth=2).count() == 0
    with pytest.raises(ValueError):
        trees.fit_forest(data, OPTS, max_features="all")
    with pytest.raises(ValueError):
        trees.fit_boosted(data, OPTS, subsample=0.0)


def test_by_name_and_any_estimator(walk, sets):
    from pyspark.ml.classification import DecisionTreeClassifier

    data, _ = sets
    once = w.WalkOptions(train_size=90, step=21, forward=3, retrain=False)
    rows = w.fit_each(data, once, lambda train: DecisionTreeClassifier(maxDepth=2), len(NAMES))
    assert rows.count() == w.prediction_rows(data, once).count()
    bars, pdf = walk
    got = w.classifier_positions(bars, "ml_rf", 80, 3, retrain=False, n_estimators=2, max_depth=1).collect()
    assert len(got) == len(pdf) and {r.target for r in got} <= {-1.0, 0.0, 1.0}
