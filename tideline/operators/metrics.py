"""Performance metrics of ledgers, one grouped aggregate per (group, period)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDEFINED_SHARPE = -99.0
#: Returns nearer to 0 count as 0 in skewness and kurtosis. A smoothed position dies away to 1e-60 and less; powers of moments of such
#: returns underflow, and the aggregates divide by them.
NO_RETURN = 1e-30
RETURN_METRICS = ("sharpe", "sortino", "calmar", "max_drawdown", "cagr", "total_return", "volatility", "win_rate",
                  "profit_factor", "skew", "kurtosis")
ACTIVITY_METRICS = ("n_observations", "trade_count", "exposure", "turnover", "requested_turnover", "fill_ratio",
                    "transaction_cost_drag", "max_participation", "capacity_constrained_bars", "borrow_blocked_bars")


def absorb_ruin(returns: DataFrame, keys, order="date", ret: str = "ret") -> DataFrame:
    """The first return at or below -1 becomes -1 and everything after it 0."""
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
    gone = F.max((F.col(ret) <= -1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return returns.withColumn(
        ret, F.when(F.coalesce(gone, F.lit(0)) == 1, 0.0).otherwise(F.greatest(F.col(ret), F.lit(-1.0)))
    )


def with_drawdown(returns: DataFrame, keys, order="date", ret: str = "ret") -> DataFrame:
    """Add ``drawdown`` from the running peak, which starts at the initial capital of 1."""
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    logs = F.coalesce(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(upto), F.lit(0.0))
    gone = F.max((F.col(ret) <= -1).cast("int")).over(upto) == 1
    df = returns.withColumn("_eq", F.when(gone, 0.0).otherwise(F.exp(logs)))
    peak = F.greatest(F.max("_eq").over(upto), F.lit(1.0))
    return df.withColumn("drawdown", F.col("_eq") / peak - 1).drop("_eq")


def with_period_drawdown(led: DataFrame, keys, order, periods=("train", "val", "test")) -> DataFrame:
    """Drawdown within each period from ``log_equity``, in one pass over the order the ledger already has.

    The running peak of a period is a conditional maximum, and its starting
    level the last value of the period before, so no second sort by period is
    needed.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("log_equity")
    marks = {}
    for i, p in enumerate(periods):
        marks[f"_peak_{p}"] = F.max(F.when(F.col("period") == p, level)).over(upto)
        if i:
            earlier = F.col("period").isin(*periods[:i])
            marks[f"_from_{p}"] = F.last(F.when(earlier, level), ignorenulls=True).over(upto)
    df = led.withColumns(marks)
    top = F.lit(None).cast("double")
    for i, p in enumerate(periods):
        start = F.coalesce(F.col(f"_from_{p}"), F.lit(0.0)) if i else F.lit(0.0)
        top = F.when(F.col("period") == p, F.greatest(F.col(f"_peak_{p}"), start)).otherwise(top)
    drawdown = F.when(F.col("ret") <= -1, -1.0).when(level.isNull(), 0.0).otherwise(F.exp(level - top) - 1)
    return df.withColumn("drawdown", drawdown).drop(*marks)


def _moments(ret: str, rf: float) -> list:
    r = F.col(ret)
    short = F.least(r - F.lit(rf) / F.col("ann"), F.lit(0.0))
    seen = F.when(F.abs(r) < NO_RETURN, 0.0).otherwise(r)
    return [
        F.count(F.lit(1)).alias("n_observations"),
        F.avg(r).alias("_mean"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_std"),
        F.sqrt(F.avg(short * short)).alias("_down"),
        F.min("drawdown").alias("_mdd"),
        F.sum(F.when(r > -1, F.log1p(r))).alias("_logs"),
        F.max((r <= -1).cast("int")).alias("_ruin"),
        F.avg((r > 0).cast("double")).alias("_win"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_gain"),
        F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("_loss"),
        F.skewness(seen).alias("_g1"),
        F.kurtosis(seen).alias("_g2"),
        F.max("ann").alias("_ann"),
    ]


def _return_columns(rf: float) -> dict:
    n, ann = F.col("n_observations").cast("double"), F.col("_ann")
    std, mean = F.col("_std"), F.col("_mean")
    flat = std < 1e-10
    excess = mean * ann - rf
    total = F.when(F.col("_ruin") == 1, -1.0).otherwise(F.exp(F.coalesce(F.col("_logs"), F.lit(0.0))) - 1)
    cagr = F.when(F.col("_ruin") == 1, -1.0).otherwise(F.exp(F.coalesce(F.col("_logs"), F.lit(0.0)) * ann / n) - 1)
    skew = F.when((n < 3) | flat, 0.0).otherwise(
        F.col("_g1") * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))
    kurt = F.when((n < 4) | flat, 0.0).otherwise(
        ((n + 1) * F.col("_g2") + 6) * (n - 1) / (F.greatest(n - 2, F.lit(1.0)) * F.greatest(n - 3, F.lit(1.0))))
    values = {
        "sharpe": F.when(flat, 0.0).otherwise(excess / (std * F.sqrt(ann) + 1e-10)),
        "sortino": F.when(F.col("_down") < 1e-10, 0.0).otherwise(
            excess / F.greatest(F.col("_down") * F.sqrt(ann), F.lit(1e-300))),
        "calmar": cagr / (F.abs(F.col("_mdd")) + 1e-10),
        "max_drawdown": F.col("_mdd"),
        "cagr": cagr,
        "total_return": total,
        "volatility": std * F.sqrt(ann),
        "win_rate": F.col("_win"),
        "profit_factor": F.col("_gain") / (F.col("_loss") + 1e-10),
        "skew": skew,
        "kurtosis": kurt,
    }
    return {name: F.bround(value, 4) for name, value in values.items()}


_SCRATCH = ("_mean", "_std", "_down", "_mdd", "_logs", "_ruin", "_win", "_gain", "_loss", "_g1", "_g2", "_ann")


def evaluate(returns: DataFrame, keys, risk_free_rate: float = 0.0, order="date", ret: str = "ret") -> DataFrame:
    """Eleven return metrics per group of realised returns (columns ``ret``, ``ann``)."""
    df = with_drawdown(absorb_ruin(returns, keys, order, ret), keys, order, ret)
    agg = df.groupBy(*keys).agg(*_moments(ret, risk_free_rate))
    return agg.withColumns(_return_columns(risk_free_rate)).drop(*_SCRATCH)


def _fold_sharpe(fold: int, rf: float):
    inside = F.col("fold") == fold
    r = F.when(inside, F.col("ret"))
    n, mean, std = F.count(r), F.avg(r), F.stddev_samp(r)
    exposure = F.avg(F.when(inside, F.abs(F.col("held"))))
    ann = F.max("ann")
    undefined = (n < 2) | (F.coalesce(std, F.lit(0.0)) < 1e-10) | (exposure <= 1e-12)
    value = F.bround((mean * ann - rf) / (std * F.sqrt(ann) + 1e-10), 4)
    return F.when(n == 0, None).when(undefined, UNDEFINED_SHARPE).otherwise(value)


def period_metrics(led: DataFrame, keys, risk_free_rate: float = 0.0, order="date", folds: int | None = None) -> DataFrame:
    """Return and activity metrics of a ledger per group; ``keys`` include the period.

    Everything, the validation folds included, comes from one aggregation. The
    Sharpe of a group that never held anything or never moved is the sentinel
    -99, which no selection may prefer to a real loss.
    """
    df = led if "drawdown" in led.columns else with_drawdown(led, keys, order)
    aggs = _moments("ret", risk_free_rate) + [
        F.count_if(F.col("trade") > 1e-12).alias("trade_count"),
        F.avg(F.abs(F.col("held"))).alias("exposure"),
        F.sum("trade").alias("turnover"),
        F.sum("requested_trade").alias("requested_turnover"),
        F.sum("txn_cost").alias("transaction_cost_drag"),
        F.max("participation").alias("max_participation"),
        F.count_if("capacity_constrained").alias("capacity_constrained_bars"),
        F.count_if("borrow_blocked").alias("borrow_blocked_bars"),
    ]
    if folds:
        aggs.append(F.array_compact(F.array(*[_fold_sharpe(i + 1, risk_free_rate) for i in range(folds)]))
                    .alias("fold_sharpes"))
    out = df.groupBy(*keys).agg(*aggs).withColumns(_return_columns(risk_free_rate))
    undefined = (F.col("exposure") <= 1e-12) | (F.col("n_observations") < 2) | (F.col("_std") < 1e-10)
    out = out.withColumns({
        "sharpe": F.when(undefined, UNDEFINED_SHARPE).otherwise(F.col("sharpe")),
        "fill_ratio": F.when(F.col("requested_turnover") > 1e-12, F.col("turnover") / F.col("requested_turnover")).otherwise(1.0),
    })
    return out.drop(*_SCRATCH)


def case_totals(led: DataFrame, keys) -> DataFrame:
    """Totals of a whole ledger: final equity, turnover, costs, trades and flags."""
    return led.groupBy(*keys).agg(
        F.max_by("equity", "date").alias("final_equity"),
        F.sum("trade").alias("turnover"),
        F.sum("requested_trade").alias("requested_turnover"),
        F.sum("txn_cost").alias("transaction_cost_drag"),
        F.count_if(F.col("trade") > 1e-12).alias("trade_count"),
        F.count_if("capacity_constrained").alias("capacity_constrained_bars"),
        F.count_if("borrow_blocked").alias("borrow_blocked_bars"),
    )
