"""Ordered train / validation / test split, validation folds and halving resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = ("train", "val", "test")


def split_ordinals(n: Column) -> tuple[Column, Column]:
    """First validation and first test ordinal of ``n`` ordered rows (40 / 40 / 20)."""
    first = F.greatest(F.lit(1), F.least(F.floor(n * 0.4), n - 2))
    second = F.greatest(first + 1, F.least(F.floor(n * 0.8), n - 1))
    return first, second


def with_periods(bars: DataFrame, keys=("ticker",), order="date") -> DataFrame:
    """Add ``period``; groups of fewer than three rows cannot be split and get NULL."""
    every = Window.partitionBy(*keys)
    seq = F.row_number().over(every.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(every)
    first, second = split_ordinals(F.col("_n"))
    return (
        bars.withColumns({"_ord": seq, "_n": n})
        .withColumn(
            "period",
            F.when(F.col("_n") < 3, None).when(F.col("_ord") < first, "train")
            .when(F.col("_ord") < second, "val").otherwise("test"),
        )
        .drop("_ord", "_n")
    )


def with_folds(bars: DataFrame, folds: int = 4, keys=("ticker",), order="date", period: str = "val") -> DataFrame:
    """Number the rows of ``period`` into ``folds`` contiguous groups whose sizes differ by at most one."""
    if folds % 2 or not 2 <= folds <= 10:
        raise ValueError("folds must be an even number between 2 and 10")
    tile = F.ntile(folds).over(Window.partitionBy(*keys, "period").orderBy(order))
    return bars.withColumn("fold", F.when(F.col("period") == period, tile))


def halving_resources(totals: DataFrame, total: str, stages: int = 3, factor: int = 3, minimum: int = 2) -> DataFrame:
    """Strictly increasing validation prefixes per row of ``totals``, the last one complete."""
    remaining = F.sequence(F.lit(stages - 1), F.lit(0))
    sizes = F.transform(
        remaining,
        lambda k: F.least(
            F.col(total), F.greatest(F.lit(minimum).cast("bigint"), F.ceil(F.col(total) / F.pow(F.lit(float(factor)), k)))
        ),
    )
    steps = F.array_sort(F.array_distinct(F.array_append(sizes, F.col(total).cast("bigint"))))
    return (
        totals.filter(F.col(total) > 0)
        .select("*", F.posexplode(steps).alias("stage", "resource_bars"))
    )


def prefix(rows: DataFrame, cutoffs: DataFrame, keys=("ticker",)) -> DataFrame:
    """Rows dated on or before each key's ``cutoff``."""
    return rows.join(cutoffs, list(keys)).filter(F.col("date") <= F.col("cutoff")).drop("cutoff")


def execution_model(name: str, delay: int = 2) -> tuple[int, str]:
    """Bars between signal and fill, and the fill price column."""
    models = {"same_close": (0, "close"), "next_close": (1, "close"), "next_open": (1, "open"),
              "delayed_close": (delay, "close")}
    if name not in models:
        raise ValueError(f"execution model must be one of {sorted(models)}")
    return models[name]
