"""Linear classifiers for all (ticker, fold) models at once: logistic regression and the linear support vector machine.

Rows of a ticker lie in blocks of some hundred bars; a pass adds up loss, gradient and curvature of every model over the blocks
of its training prefix, at a few step lengths at once, and takes the best damped Newton step per model. What moves between passes
are some thousand numbers per model and block, never rows per fold; a ticker spans as many tasks as it has blocks and chunks of folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .walkforward import WalkOptions, fold_table, prediction_rows, training_moments

#: Bars in a block, and folds that meet a block together.
BLOCK_BARS, FOLD_CHUNK = 256, 64
#: The hinge is the limit of smooth losses: width of the first, of the last, and what a level divides it by.
FIRST_WIDTH, LAST_WIDTH, NARROW = 1.0, 1e-6, 3.0
#: Step lengths that a pass tries, by loss.
LENGTHS = {"logistic": (1.0,), "hinge": (1.0, 1 / 6, 1 / 36)}

_STATE = ("fold bigint, cut int, mean array<double>, std array<double>, base array<double>, step array<double>, reach double, "
          "value double, width double, done boolean, passes int")
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def smooth_loss(margin: np.ndarray, at: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of width * ln(1 + exp((at - margin) / width)): logistic for (0, 1), towards the hinge for (1, 0)."""
    u = (at - margin) / width
    share = np.exp(-np.logaddexp(0.0, -u))
    return width * np.logaddexp(0.0, u), -share, share * (1.0 - share) / width


def _partials(at: float, lengths: tuple[float, ...]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {c: [] for c in ("ticker", *_NAMES, "loss", "slope", "curve")}
            for r in range(batch.num_rows):
                rows, models = batch.column("rows")[r].values, batch.column("models")[r].values
                seq, y = np.asarray(rows.field("_seq")), np.where(np.asarray(rows.field("label")) == 1, 1.0, -1.0)
                x = np.asarray(rows.field("x").flatten()).reshape(len(seq), -1)
                upper = np.triu_indices(x.shape[1] + 1)
                for model in models.to_pylist():
                    mine = seq <= model["cut"]
                    if not mine.any():
                        continue
                    z = np.column_stack([(x[mine] - model["mean"]) / model["std"], np.ones(mine.sum())])
                    sums = [[], [], []]
                    for length in lengths:
                        trial = np.array(model["base"]) + model["reach"] * length * np.array(model["step"])
                        loss, slope, curve = smooth_loss(y[mine] * (z @ trial), at, model["width"])
                        for total, part in zip(sums, ([loss.sum()], (slope * y[mine]) @ z, ((z * curve[:, None]).T @ z)[upper]), strict=True):
                            total.append(part)
                    out["ticker"].append(batch.column("ticker")[r].as_py())
                    for c in _NAMES:
                        out[c].append(model[c])
                    for c, total in zip(("loss", "slope", "curve"), sums, strict=True):
                        out[c].append(np.concatenate(total))
            kinds = {"ticker": pa.string(), "fold": pa.int64(), "cut": pa.int32(), "reach": pa.float64(), "value": pa.float64(), "width": pa.float64(),
                     "done": pa.bool_(), "passes": pa.int32()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.list_(pa.float64()))) for c, v in out.items()})

    return run


def direction(slope: np.ndarray, curve: np.ndarray, at: np.ndarray, penalty: str) -> tuple[np.ndarray, float]:
    """Minimiser of the quadratic model plus penalty, as a step from ``at``, and by how much the model falls. The last entry, the
    intercept, has no penalty. For l1 coordinates are minimised in turn until none moves."""
    if penalty == "l2":
        ridge = np.append(np.ones(len(at) - 1), 0.0)
        slope, curve = slope + ridge * at, curve + np.diag(ridge)
        curve = curve + np.eye(len(at)) * 1e-13 * np.trace(curve)
        step = -np.linalg.solve(curve, slope)
        return step, float(-0.5 * slope @ step)
    curve = curve + np.eye(len(at)) * (1e-12 * np.trace(curve) + 1e-12)
    new, pull = at.copy(), slope.copy()  # pull: gradient of the quadratic at new
    for _ in range(2000):
        moved = 0.0
        for j in range(len(at)):
            goal = new[j] - pull[j] / curve[j, j]
            if j < len(at) - 1:
                goal = np.sign(goal) * max(0.0, abs(goal) - 1.0 / curve[j, j])
            d = goal - new[j]
            if d:
                new[j] = goal
                pull += d * curve[:, j]
                moved = max(moved, d * d * curve[j, j])
        if moved < 1e-16:
            break
    step = new - at
    fall = -(slope @ step + 0.5 * step @ curve @ step + np.abs(new[:-1]).sum() - np.abs(at[:-1]).sum())
    return step, float(fall)


def advance(s: dict, sums: list[tuple[float, np.ndarray, np.ndarray]], lengths: tuple[float, ...], cost: float, penalty: str, last: float,
            tolerance: float) -> None:
    """One model's next trials from the sums at its present ones: go on from the best, or try shorter steps from where it was."""
    base, step, tries = np.array(s["base"]), np.array(s["step"]), []
    for length, (loss, slope, curve) in zip(lengths, sums, strict=True):
        trial = base + s["reach"] * length * step
        weights = trial[:-1]
        tries.append((cost * loss + (0.5 * weights @ weights if penalty == "l2" else np.abs(weights).sum()), trial, slope, curve))
    value, trial, slope, curve = min(tries, key=lambda t: t[0])
    s["passes"] += 1
    if not value <= s["value"]:
        s["reach"] *= lengths[-1] / 6
        if s["reach"] * np.abs(step).max() > 1e-14 * (1 + np.abs(base).max()):
            return
        # no shorter step helps: this is the minimum up to rounding
        s["done"] = s["width"] <= last
        if not s["done"]:
            s.update(width=_narrowed(s["width"], last), value=float("inf"), step=[0.0] * len(step), reach=1.0)
        return
    move, fall = direction(cost * slope, cost * curve, trial, penalty)
    s.update(base=trial.tolist(), value=float(value), step=move.tolist(), reach=1.0)
    if s["width"] > last and fall <= cost * s["width"]:  # near enough to the path: narrow the loss, start over from here
        s.update(width=_narrowed(s["width"], last), value=float("inf"), step=[0.0] * len(step))
        return
    s["done"] = bool(s["width"] <= last and fall <= tolerance * max(abs(value), 1e-300))
    if s["done"] and last >= FIRST_WIDTH:  # a smooth loss: the last step is as safe as it is short
        s["base"] = (trial + move).tolist()


def _narrowed(width: float, last: float) -> float:
    return max(last, width / NARROW)


def fit_linear(data: DataFrame, opts: WalkOptions, C: float = 1.0, penalty: str = "l2", loss: str = "logistic", width: int = 55,
               tolerance: float = 1e-10, passes: int = 300) -> DataFrame:
    """One row per fitted (ticker, fold): cut, mean, std, coef (on standardised features), intercept, objective, passes, settled.

    The objective is C * sum of losses + |w|^2 / 2 (``l2``) or + |w|_1 (``l1``), the intercept free; losses are ``logistic`` or
    ``hinge``. The latter is reached through smooth losses of falling width, each started where the wider one ended. ``data`` is
    from :func:`walkforward.labelled`. With ``retrain=False`` only the first fold of a ticker that can be fitted is. A pass is a join
    and a grouped sum, written before the next; models that have settled are not visited again.
    """
    if penalty not in ("l1", "l2") or loss not in ("logistic", "hinge") or not C > 0:
        raise ValueError("penalty must be l1 or l2, loss logistic or hinge, C positive")
    at, first, last = (0.0, 1.0, 1.0) if loss == "logistic" else (1.0, FIRST_WIDTH, LAST_WIDTH)
    lengths = LENGTHS[loss]
    usable = data.where("x is not null and label is not null")
    blocks = cut_lineage(usable.groupBy("ticker", F.floor(F.col("_seq") / BLOCK_BARS).alias("block")).agg(
        F.min("_seq").alias("_from"), F.collect_list(F.struct("_seq", "label", "x")).alias("rows")))
    folds = fold_table(data, opts).where("fitted")
    if not opts.retrain:
        folds = folds.groupBy("ticker").agg(F.min("fold").alias("fold"), F.min_by("cut", "fold").alias("cut"))
    stats = training_moments(data, width).select("ticker", "cut", "mean", F.transform("std", lambda s: F.when(s == 0, 1.0).otherwise(s)).alias("std"))
    zero = F.array_repeat(F.lit(0.0), width + 1)
    state = folds.select("ticker", "fold", F.col("cut").cast("int").alias("cut")).join(stats, ["ticker", "cut"]).select(
        "ticker", "fold", "cut", "mean", "std", zero.alias("base"), zero.alias("step"), F.lit(1.0).alias("reach"),
        F.lit(float("inf")).alias("value"), F.lit(first).alias("width"), F.lit(False).alias("done"), F.lit(0).alias("passes"))
    state, schema = cut_lineage(state), f"ticker string, {_STATE}"

    def step(table):
        import pyarrow as pa

        s = {c: table.column(c)[0].as_py() for c in ("ticker", *_NAMES)}
        add = lambda c: np.asarray(table.column(c).combine_chunks().flatten()).reshape(table.num_rows, len(lengths), -1).sum(axis=0)
        upper, sums = np.triu_indices(width + 1), []
        for losses, slope, cells in zip(add("loss"), add("slope"), add("curve"), strict=True):
            curve = np.zeros((width + 1, width + 1))
            curve[upper] = cells
            sums.append((float(losses[0]), slope, curve + np.triu(curve, 1).T))
        advance(s, sums, lengths, C, penalty, last, tolerance)
        return pa.Table.from_pylist([s], schema=pa.schema([table.schema.field(c) for c in ("ticker", *_NAMES)]))

    settled = None
    for _ in range(passes):
        open_ = state.where("not done")
        chunks = open_.groupBy("ticker", F.floor(F.col("fold") / FOLD_CHUNK).alias("chunk")).agg(
            F.max("cut").alias("_last"), F.collect_list(F.struct(*_NAMES)).alias("models"))
        met = blocks.join(chunks, "ticker").where("_from <= _last").select("ticker", "rows", "models")
        sums = met.mapInArrow(_partials(at, lengths), f"{schema}, loss array<double>, slope array<double>, curve array<double>")
        state = cut_lineage(sums.groupBy("ticker", "fold").applyInArrow(step, schema))
        ready = state.where("done")
        settled = ready if settled is None else settled.unionByName(ready)
        if not state.where("not done").head(1):
            break
    else:
        settled = settled.unionByName(state.where("not done"))
    return settled.select(
        "ticker", "fold", "cut", "mean", "std", F.slice("base", 1, width).alias("coef"), F.element_at("base", -1).alias("intercept"),
        F.col("value").alias("objective"), "passes", F.col("done").alias("settled"))


def linear_predictions(data: DataFrame, opts: WalkOptions, models: DataFrame, width: int = 55) -> DataFrame:
    """``ticker, date, fold, score, pred`` of every predictable row by the model that serves it."""
    rows = prediction_rows(data, opts).join(models.select("ticker", "cut", "mean", "std", "coef", "intercept"), ["ticker", "cut"])
    score = F.expr(f"aggregate(sequence(0, {width - 1}), intercept, (acc, i) -> acc + (x[i] - mean[i]) / std[i] * coef[i])")
    return rows.withColumn("score", score).select("ticker", "date", "fold", "score", F.when(F.col("score") > 0, 1).otherwise(0).alias("pred"))


def logistic_regression(data: DataFrame, opts: WalkOptions, C: float = 1.0, penalty: str = "l2", width: int = 55) -> DataFrame:
    """Predictions of l1 or l2 logistic regression, one model per ticker and fold."""
    return linear_predictions(data, opts, fit_linear(data, opts, C, penalty, "logistic", width), width)


def linear_svm(data: DataFrame, opts: WalkOptions, C: float = 1.0, width: int = 55) -> DataFrame:
    """Predictions of the linear support vector machine (hinge loss, free intercept), one model per ticker and fold."""
    return linear_predictions(data, opts, fit_linear(data, opts, C, "l2", "hinge", width), width)
