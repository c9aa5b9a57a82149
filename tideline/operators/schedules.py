"""Dated step functions (rates, spreads, borrow flags) aligned to bars.

A schedule is ``(effective_at, value)``, optionally per key. It is aligned to
the distinct dates of the bars, which the calendar bounds, and then
equi-joined, so a change never multiplies the bars it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR_SECONDS = 365.25 * 24 * 60 * 60


def _states(schedule: DataFrame, keys) -> DataFrame:
    """Schedule with the integral of the value up to each change."""
    w = Window.partitionBy(*keys, "_all").orderBy("effective_at")
    at = F.unix_micros(F.col("effective_at").cast("timestamp")) / 1e6
    area = F.lag("value").over(w).cast("double") * (F.col("_at") - F.lag("_at").over(w))
    return (
        schedule.withColumns({"_at": at, "_all": F.lit(0)})
        .withColumn("_area", F.coalesce(area, F.lit(0.0)))
        .withColumn("_cum", F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_area", "_all")
    )


def _as_of(dates: DataFrame, states: DataFrame, keys) -> DataFrame:
    """Last state effective at or before each date: one ordered pass over dates and changes together."""
    left = dates.select(*keys, "date", F.unix_micros(F.col("date").cast("timestamp")).alias("_us"),
                        F.lit(None).cast(f"struct<value:{dict(states.dtypes)['value']},at:double,cum:double>").alias("_st"))
    right = states.select(*keys, F.lit(None).cast("date").alias("date"),
                          F.unix_micros(F.col("effective_at").cast("timestamp")).alias("_us"),
                          F.struct(F.col("value"), F.col("_at").alias("at"), F.col("_cum").alias("cum")).alias("_st"))
    both = left.unionByName(right).withColumn("_all", F.lit(0))
    # a change at the very instant of a bar applies to it, so changes sort first
    w = Window.partitionBy(*keys, "_all").orderBy("_us", F.col("date").isNotNull())
    last = F.last("_st", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_st", last).filter(F.col("date").isNotNull()).select(*keys, "date", "_us", "_st")


def as_of(bars: DataFrame, schedule: DataFrame, name: str, keys=(), strict: bool = True) -> DataFrame:
    """Add column ``name``: the schedule's value at each bar, never looking forward.

    With ``strict`` a bar before the first change fails the job.
    """
    dates = bars.select(*keys, "date").distinct()
    found = _as_of(dates, _states(schedule, keys), keys)
    value = F.col("_st.value")
    if strict:
        kind = dict(schedule.dtypes)["value"]
        value = F.when(value.isNull(), F.raise_error(F.lit(f"{name} schedule must cover the first bar")).cast(kind)).otherwise(value)
    return bars.join(found.select(*keys, "date", value.alias(name)), [*keys, "date"])


def accrual(bars: DataFrame, schedule: DataFrame, name: str, keys=(), bar_keys=("ticker",)) -> DataFrame:
    """Add column ``name``: the integral of an annual rate between consecutive bars, in years.

    The integral up to any instant is ``cum + value * (t - effective_at)``, so
    the accrual of a bar is the difference of two as-of lookups and changes
    inside an interval are honoured without an overlap join.
    """
    dates = bars.select(*keys, "date").distinct()
    found = _as_of(dates, _states(schedule, keys), keys)
    st = F.col("_st")
    total = st["cum"] + st["value"] * (F.col("_us") / 1e6 - st["at"])
    guarded = F.when(st.isNull(), F.raise_error(F.lit(f"{name} schedule must cover the first bar")).cast("double")).otherwise(total)
    joined = bars.join(found.select(*keys, "date", guarded.alias("_total")), [*keys, "date"])
    w = Window.partitionBy(*bar_keys).orderBy("date")
    step = (F.col("_total") - F.lag("_total").over(w)) / YEAR_SECONDS
    return joined.withColumn(name, F.coalesce(step, F.lit(0.0))).drop("_total")


def constant_accrual(rate: float, window) -> "F.Column":
    """Accrual of a constant annual rate over actual elapsed days / 365.25."""
    days = F.datediff("date", F.lag("date").over(window))
    return F.coalesce(F.lit(float(rate)) * days / 365.25, F.lit(0.0))
