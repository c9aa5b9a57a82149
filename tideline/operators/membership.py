"""Dated index membership: checks and the eligibility of every (session, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_problems(events: DataFrame, opening: DataFrame) -> DataFrame:
    """Events outside coverage, announced late, of unknown action, duplicated or redundant."""
    w = Window.partitionBy("ticker").orderBy("effective_on", "known_on")
    start = opening.select("ticker").distinct().withColumn("_open", F.lit(True))
    df = events.join(start, "ticker", "left").withColumns({
        "_same": F.count(F.lit(1)).over(Window.partitionBy("ticker", "effective_on")),
        "_last": F.lag("action").over(w),
    })
    member = F.when(F.col("_last").isNull(), F.coalesce("_open", F.lit(False))).otherwise(F.col("_last") == "add")
    rules = {
        "coverage": ~((F.col("coverage_start") < F.col("effective_on")) & (F.col("effective_on") <= F.col("coverage_end"))),
        "retroactive": F.col("known_on") > F.col("effective_on"),
        "action": ~F.col("action").isin("add", "remove"),
        "duplicate": F.col("_same") > 1,
        "redundant": (F.col("action") == "add") == member,
    }
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("problems", tags).filter(F.size("problems") > 0).select(
        "ticker", "known_on", "effective_on", "action", "problems")


def coverage_problems(bars: DataFrame, events: DataFrame, opening: DataFrame, start, end) -> DataFrame:
    """Sessions outside the declared coverage and named tickers without any bar."""
    span = bars.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    uncovered = span.filter((F.col("a") < F.lit(start).cast("date")) | (F.col("b") > F.lit(end).cast("date"))).select(
        F.lit("coverage").alias("problem"), F.lit(None).cast("string").alias("ticker"))
    named = events.select("ticker").unionByName(opening.select("ticker")).distinct()
    unknown = named.join(bars.select("ticker").distinct(), "ticker", "left_anti").select(
        F.lit("no_data").alias("problem"), "ticker")
    return uncovered.unionByName(unknown)


def eligibility(sessions: DataFrame, events: DataFrame, opening: DataFrame) -> DataFrame:
    """``ticker, date, eligible`` for every row of ``sessions``.

    A change takes effect on the first session on or after its date; changes
    before the first session set the opening state. Events and sessions of a
    ticker are merged in one ordered pass.
    """
    start = opening.select("ticker").distinct().withColumn("_open", F.lit(True))
    marks = sessions.select("ticker", "date", F.lit(None).cast("boolean").alias("_add"), F.lit(1).alias("_kind"))
    changes = events.select("ticker", F.col("effective_on").alias("date"), (F.col("action") == "add").alias("_add"), F.lit(0).alias("_kind"))
    w = Window.partitionBy("ticker").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(changes).withColumn("_state", F.last("_add", ignorenulls=True).over(w)).filter("_kind = 1")
    return merged.join(start, "ticker", "left").select(
        "ticker", "date", F.coalesce("_state", "_open", F.lit(False)).alias("eligible"))


def with_membership_change(eligible: DataFrame) -> DataFrame:
    """Add ``changed``: any difference from the ticker's previous session (true on its first)."""
    w = Window.partitionBy("ticker").orderBy("date")
    return eligible.withColumn("changed", F.coalesce(F.col("eligible") != F.lag("eligible").over(w), F.lit(True)))
