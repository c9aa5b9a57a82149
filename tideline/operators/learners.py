"""Grids of walk-forward classifiers: what parameter sets have in common is computed once for all of them.

Sets that only differ in smoothing, direction or size share a model. Naive Bayes shares one table of running moments among all
``var_smoothing``, nearest neighbours one distance-ordered list among all ``n_neighbors`` and weights of a metric. The other
classifiers fit one family of models per setting. Labels and folds are shared by all sets of one horizon and window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..session import cut_lineage
from . import walkforward as w
from .grid import canonical, sql_literal

#: parameters that don't belong to the model
WINDOW = ("lookback", "forward", "retrain", "step", "embargo")
OUTER = ("long_short", "signal_smooth", "position_size")
DEFAULTS = {"lookback": 504, "forward": 1, "retrain": True, "embargo": 0, "long_short": True, "signal_smooth": 0, "position_size": 1.0}
MODEL_DEFAULTS = {
    "ml_nb": {"var_smoothing": 1e-7}, "ml_knn": {"n_neighbors": 10, "weights": "uniform", "p": 2}, "ml_logreg": {"C": 1.0, "penalty": "l2"},
    "ml_svm": {"C": 1.0, "kernel": "linear"},
    "ml_rf": {"n_estimators": 100, "max_depth": 5, "min_samples_split": 2, "max_features": "sqrt"},
    "ml_xgb": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0},
}


def completed(name: str, row: Mapping) -> dict:
    """A parameter set with the defaults of its classifier."""
    full = {**DEFAULTS, "step": 42 if name == "ml_svm" else 21, **MODEL_DEFAULTS[name], **row}
    unknown = set(full) - set(DEFAULTS) - {"step"} - set(MODEL_DEFAULTS[name])
    if unknown:
        raise ValueError(f"unknown parameters for {name}: {sorted(unknown)}")
    return full


def complaint(name: str, p: Mapping) -> str | None:
    """Why a parameter set can't be evaluated, or None."""
    if p["forward"] < 1 or p["embargo"] < 0 or p["lookback"] < 1 or p["step"] < 1:
        return "forward, lookback and step must be positive, embargo non-negative"
    if name == "ml_knn" and (p["weights"] not in ("uniform", "distance") or p["p"] not in (1, 2)):
        return "weights must be uniform or distance, p 1 or 2"
    if name == "ml_knn" and not w.knn_valid(p, p["step"]):
        return "n_neighbors exceeds the rows of the first training window"
    if name == "ml_svm" and p["kernel"] != "linear":
        return "only the linear kernel is supported"
    if name in ("ml_logreg", "ml_svm") and not p["C"] > 0:
        return "C must be positive"
    return None


def _predictions(name: str, data: DataFrame, opts: w.WalkOptions, models: list[dict], moments: DataFrame | None) -> DataFrame:
    """``ticker, date, variant, pred``; ``variant`` numbers the distinct ``models``."""
    if name == "ml_nb":
        return w.naive_bayes_grid(data, opts, [m["var_smoothing"] for m in models], moments=moments).select("ticker", "date", "variant", "pred")
    if name == "ml_knn":
        return w.neighbour_grid(data, opts, [(m["n_neighbors"], m["weights"], m["p"]) for m in models]).select("ticker", "date", "variant", "pred")
    each = [w.CLASSIFIERS[name](data, opts, **m).select("ticker", "date", F.lit(i).alias("variant"), "pred") for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, each)


def grid_targets(bars: DataFrame, name: str, rows: Sequence[Mapping]) -> DataFrame:
    """``ticker, date, pid, signal_smooth, target`` of every valid parameter set on every bar; ``pid`` is its place in ``rows``."""
    sets = [(pid, completed(name, row)) for pid, row in enumerate(rows)]
    groups: dict[tuple, list] = {}
    for pid, p in sets:
        if complaint(name, p) is None:
            groups.setdefault((p["forward"], *[p[c] for c in WINDOW if c != "forward"]), []).append((pid, p))
    shared: dict[int, tuple] = {}
    out = []
    for key, members in groups.items():
        p = members[0][1]
        opts = w.WalkOptions(p["lookback"], p["step"], p["forward"], p["embargo"], p["retrain"])
        if key[0] not in shared:
            data = cut_lineage(w.labelled(bars, opts))
            shared[key[0]] = data, cut_lineage(w.training_moments(data, 55)) if name == "ml_nb" else None
        data, moments = shared[key[0]]
        own = tuple(MODEL_DEFAULTS[name])
        models = list(dict.fromkeys(tuple(q[c] for c in own) for _, q in members))
        pred = _predictions(name, data, opts, [dict(zip(own, m, strict=True)) for m in models], moments)
        packed = ",".join(
            f"named_struct('pid',{pid}L,'variant',{models.index(tuple(q[c] for c in own))},'_ls',{str(bool(q['long_short'])).lower()},"
            f"'signal_smooth',{int(q['signal_smooth'])},'_size',{sql_literal(q['position_size'], True)})" for pid, q in members)
        asked = data.select("ticker", "date", F.expr(f"inline(array({packed}))")).join(pred, ["ticker", "date", "variant"], "left")
        target = F.when(F.col("pred") == 1, 1.0).when((F.col("pred") == 0) & F.col("_ls"), -1.0).otherwise(0.0)
        out.append(asked.select("ticker", "date", "pid", "signal_smooth", "_size", target.alias("target")))
    if not out:
        return bars.sparkSession.createDataFrame([], "ticker string, date date, pid bigint, signal_smooth int, target double")
    df = reduce(DataFrame.unionByName, out)
    spans = sorted({p["signal_smooth"] for _, p in sets if p["signal_smooth"] > 0})
    if spans:
        df = k.with_ewm(df, [("target", k.span_alpha(s), f"_sm_{s}") for s in spans], ("ticker", "pid"))
        smooth = F.col("target")
        for s in spans:
            smooth = F.when(F.col("signal_smooth") == s, F.col(f"_sm_{s}")).otherwise(smooth)
        df = df.withColumn("target", smooth)
    return df.select("ticker", "date", "pid", "signal_smooth", (F.col("target") * F.col("_size")).alias("target"))


def labels(base: DataFrame, name: str, rows: Sequence[Mapping]) -> DataFrame:
    """``ticker, pid, signal_smooth, params, complaint`` of every set for each ticker of ``base``."""
    text = lambda v: "cast(null as string)" if v is None else sql_literal(v)
    packed = ",".join(
        f"named_struct('pid',{pid}L,'signal_smooth',{int(row.get('signal_smooth', 0))},'params',{text(canonical(row))},"
        f"'complaint',{text(complaint(name, completed(name, row)))})" for pid, row in enumerate(rows))
    return base.select("ticker").distinct().select("ticker", F.expr(f"inline(array({packed}))"))
