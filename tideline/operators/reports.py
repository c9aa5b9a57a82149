"""Report tables: long (label, value) forms of summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null


def unpivot_metrics(df: DataFrame, keys: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """One row per (keys, label) with the metric's value; non-finite values become null."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), finite_or_null(F.col(c).cast("double")).alias("value")) for c, label in labels.items()])
    return df.select(*keys, F.inline(pairs))


def side_by_side(df: DataFrame, key: str, columns: Mapping[str, str], labels: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics as rows, one column per value of ``key`` (validation / test / benchmark, strategy / benchmark)."""
    long = unpivot_metrics(df, (*by, key), labels)
    return long.groupBy(*by, "label").agg(*[F.max(F.when(F.col(key) == value, F.col("value"))).alias(name) for value, name in columns.items()])


def allocations(summary: DataFrame) -> DataFrame:
    """Final weight, last target and score per asset, and the uninvested cash."""
    assets = summary.select(F.col("ticker").alias("asset"), F.col("latest_weight").alias("final_weight"), "last_target", "last_score")
    cash = summary.agg(
        F.lit("Uninvested cash").alias("asset"), F.max("latest_cash_weight").alias("final_weight"),
        F.greatest(F.lit(0.0), 1 - F.sum("last_target")).alias("last_target"), F.lit(None).cast("double").alias("last_score"))
    return assets.unionByName(cash)


def top_table(best: DataFrame) -> DataFrame:
    """Flat top-N export: identity, both metric sets and the diagnostics."""
    keep = [c for c in best.columns if c not in ("pid", "signal_smooth", "error", "ann")]
    flat = [F.to_json(c).alias(c) if dict(best.dtypes)[c].startswith("array") else F.col(c) for c in keep]
    return best.select(*flat)


def fixed(c: Column, digits: int) -> Column:
    """A double as text with ``digits`` decimals, rounded once and from its exact value (ties to the even digit)."""
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(odd, c.cast("string")).otherwise(F.replace(F.format_number(c, digits), F.lit(","), F.lit("")))


def interval_table(statistics: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """Bootstrap statistics as text rows: estimate, interval and status; numbers with ``digits`` decimals."""
    percent = F.col("statistic").isin("strategy_annualized_mean", "benchmark_annualized_mean", "annualized_mean_excess")
    scale = F.when(percent, 100.0).otherwise(1.0)
    unit = F.when(percent, "%").otherwise("")
    text = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.concat(fixed(F.col(c) * scale, digits), unit))
    interval = F.when(F.col("ci_low").isNull(), "Not estimated").otherwise(
        F.concat(F.lit("["), text("ci_low"), F.lit(", "), text("ci_high"), F.lit("]")))
    return statistics.select(*keys, "statistic", text("estimate").alias("estimate"), interval.alias("interval"), "status")
