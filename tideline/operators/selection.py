"""Ranking of candidates with multiple-testing corrections, per ticker."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_cdf, normal_quantile

EULER_GAMMA = 0.5772156649015329
Z_95 = 1.959963984540054
IDENTITY = ("strategy", "params")


def valid_score(score: str = "val_sharpe") -> Column:
    return F.col("error").isNull() & (F.col(score) > -99)


def eligible(min_bars: int = 60, min_trades: int = 1, min_exposure: float = 0.01) -> Column:
    return (
        valid_score() & (F.col("val_n_observations") >= min_bars) & (F.col("val_trade_count") >= min_trades)
        & (F.col("val_exposure") >= min_exposure)
    )


def hurdle(std: Column, trials: Column) -> Column:
    """Expected maximum Sharpe of ``trials`` independent null candidates."""
    n = trials.cast("double")
    z = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e))
    return F.when((n > 1) & (std > 0), std * z).otherwise(0.0)


def _variance_term(sharpe: Column) -> Column:
    kurt = F.col("val_kurtosis") + 3.0
    return F.greatest(1.0 - F.col("val_skew") * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe, F.lit(1e-12))


def deflated_sharpe(ann: Column, bar: Column) -> Column:
    """Probability that the Sharpe ratio exceeds the hurdle."""
    s, b, n = F.col("val_sharpe") / F.sqrt(ann), bar / F.sqrt(ann), F.col("val_n_observations")
    z = (s - b) * F.sqrt(n - 1) / F.sqrt(_variance_term(s))
    return F.when(n < 2, 0.0).otherwise(normal_cdf(z))


def sharpe_interval(ann: Column) -> tuple[Column, Column]:
    s, n = F.col("val_sharpe") / F.sqrt(ann), F.col("val_n_observations")
    error = F.when(n >= 2, F.sqrt(_variance_term(s) / (n - 1)) * F.sqrt(ann))
    return F.col("val_sharpe") - Z_95 * error, F.col("val_sharpe") + Z_95 * error


def dispersion(results: DataFrame, by=("ticker",)) -> DataFrame:
    """Trials, errors and the sample deviation of the valid Sharpe ratios."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(valid_score()).alias("trials"),
        F.coalesce(F.stddev_samp(F.when(valid_score(), F.col("val_sharpe"))), F.lit(0.0)).alias("sharpe_std"),
    )


def diagnose(results: DataFrame, by=("ticker",), overrides: DataFrame | None = None, **limits) -> DataFrame:
    """Eligible candidates with their hurdle, deflated Sharpe probability, interval and fold statistics.

    ``results`` carries ``ann``. ``overrides`` (by, trials, sharpe_std) replaces
    the counts when a staged search scored more candidates than it kept.
    """
    stats = dispersion(results, by).select(*by, "trials", "sharpe_std")
    if overrides is not None:
        over = overrides.select(*by, F.col("trials").alias("_t"), F.col("sharpe_std").alias("_s"))
        stats = stats.join(over, list(by), "left").select(
            *by, F.greatest("trials", F.coalesce("_t", F.lit(0))).alias("trials"),
            F.coalesce("_s", "sharpe_std").alias("sharpe_std"))
    stats = stats.withColumn("hurdle", hurdle(F.col("sharpe_std"), F.col("trials")))
    df = results.filter(eligible(**limits)).join(stats, list(by))
    low, high = sharpe_interval(F.col("ann"))
    folds = F.filter("val_fold_sharpes", lambda x: x > -99)
    count = F.size("_f").cast("double")
    mean = F.aggregate("_f", F.lit(0.0), lambda a, x: a + x) / F.greatest(count, F.lit(1.0))
    spread = F.aggregate("_f", F.lit(0.0), lambda a, x: a + (x - F.col("fold_mean")) * (x - F.col("fold_mean")))
    return (
        df.withColumns({"deflated_sharpe": deflated_sharpe(F.col("ann"), F.col("hurdle")), "sharpe_low": low,
                        "sharpe_high": high, "_f": folds})
        .withColumn("fold_mean", F.when(count > 0, mean))
        .withColumns({"fold_std": F.when(count > 1, F.sqrt(spread / (count - 1))).otherwise(0.0),
                      "fold_worst": F.array_min("_f"), "fold_count": F.size("_f")})
        .drop("_f")
    )


def top(diagnosed: DataFrame, n: int, by=("ticker",)) -> DataFrame:
    """Best ``n`` per group; ties fall to the higher Sharpe, then to strategy and params."""
    w = Window.partitionBy(*by).orderBy(F.desc("deflated_sharpe"), F.desc("val_sharpe"), *IDENTITY)
    return diagnosed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# --- fold-based diagnostics: all are grouped aggregates; candidates of a group never meet in one task -----------------

def _fold_rows(diagnosed: DataFrame, folds: int, by) -> DataFrame:
    return diagnosed.filter(F.col("fold_count") == folds).select(*by, *IDENTITY, "val_fold_sharpes")


def _mean_of(picks) -> Column:
    total = F.lit(0.0)
    for i in picks:
        total = total + F.get("val_fold_sharpes", F.lit(i))
    return total / float(len(picks))


def _winners(scored: DataFrame, keys, inner: str = "inner_score") -> DataFrame:
    """The first candidate in (strategy, params) order among those with the highest inner score."""
    best = scored.groupBy(*keys).agg(F.max(inner).alias("_best"), F.count(F.lit(1)).alias("candidates"))
    tied = scored.join(best, list(keys)).filter(F.col(inner) == F.col("_best"))
    return tied.groupBy(*keys).agg(
        F.min(F.struct(*IDENTITY, F.col("outer_score"), F.col(inner).alias("inner_score"))).alias("w"),
        F.max("candidates").alias("candidates"),
    ).select(*keys, "candidates", "w.*")


def overfitting_probability(diagnosed: DataFrame, folds: int = 4, by=("ticker",)) -> DataFrame:
    """Share of the symmetric fold splits in which the in-sample winner lands in the lower out-of-sample half."""
    splits = list(itertools.combinations(range(folds), folds // 2))
    rows = _fold_rows(diagnosed, folds, by)
    packed = F.array(*[
        F.struct(F.lit(i).alias("split"), _mean_of(inside).alias("inner_score"),
                 _mean_of([f for f in range(folds) if f not in inside]).alias("outer_score"))
        for i, inside in enumerate(splits)
    ])
    scored = rows.select(*by, *IDENTITY, F.inline(packed))
    keys = (*by, "split")
    picked = _winners(scored, keys).select(*keys, F.col("outer_score").alias("_picked"))
    ranks = scored.join(picked, list(keys)).groupBy(*keys).agg(
        F.count_if(F.col("outer_score") < F.col("_picked")).alias("_lower"),
        F.count_if(F.col("outer_score") == F.col("_picked")).alias("_tied"),
        F.count(F.lit(1)).alias("candidates"),
        (F.max("outer_score") - F.min("outer_score")).alias("_range"),
    )
    share = (F.col("_lower") + (F.col("_tied") + 1.0) / 2.0) / (F.col("candidates") + 1.0)
    bounded = F.greatest(F.least(share, F.lit(1 - 1e-9)), F.lit(1e-9))
    logit = F.log(bounded / (1 - bounded))
    return (
        ranks.filter((F.col("_range") > 1e-15) & (F.col("candidates") >= 2))
        .groupBy(*by)
        .agg(F.avg((logit <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("combinations"),
             F.max("candidates").alias("candidates"))
    )


def walk_forward_replay(diagnosed: DataFrame, folds: int = 4, by=("ticker",)) -> DataFrame:
    """Choose on all earlier folds, score on the next: one row per (group, outer fold)."""
    rows = _fold_rows(diagnosed, folds, by)
    packed = F.array(*[
        F.struct(F.lit(f + 1).alias("outer_fold"), _mean_of(range(f)).alias("inner_score"),
                 F.get("val_fold_sharpes", F.lit(f)).alias("outer_score"))
        for f in range(1, folds)
    ])
    scored = rows.select(*by, *IDENTITY, F.inline(packed))
    return _winners(scored, (*by, "outer_fold")).filter(F.col("candidates") >= 2)


def replay_summary(steps: DataFrame, by=("ticker",)) -> DataFrame:
    return steps.groupBy(*by).agg(
        F.avg("outer_score").alias("mean_outer_sharpe"), F.min("outer_score").alias("worst_outer_sharpe"),
        F.avg((F.col("outer_score") > 0).cast("double")).alias("positive_outer_fraction"))


# --- successive halving -----------------------------------------------------------------------------------------------

def stage_score() -> Column:
    """Validation Sharpe; minus infinity for a failed or inactive candidate."""
    bad = F.col("error").isNotNull() | (F.col("val_exposure") <= 1e-12) | F.col("val_sharpe").isNull()
    return F.when(bad, F.lit(float("-inf"))).otherwise(F.col("val_sharpe"))


def survivors(results: DataFrame, factor: int = 3, by=("ticker", "strategy")) -> DataFrame:
    """Mark the best ``ceil(n / factor)`` candidates per group as ``advanced``; ties break by params.

    A group is one ticker's candidates of one strategy, which the grid bounds.
    """
    every = Window.partitionBy(*by)
    df = results.withColumn("score", stage_score())
    rank = F.row_number().over(every.orderBy(F.desc("score"), "params"))
    keep = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(every) / F.lit(float(factor))))
    return df.withColumn("advanced", rank <= keep)


def stage_summary(stages: DataFrame, by=("stage", "strategy")) -> DataFrame:
    """Inputs, advanced, errors and best score per stage and strategy, with stage totals."""
    return stages.rollup(*by).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("advanced").alias("advanced_count"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.max(F.when(F.col("score") > float("-inf"), F.col("score"))).alias("best_score"),
    )
