"""Compare two sets of ledgers bar by bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RTOL, ATOL = 1e-9, 1e-11


def bars_of(led: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """Add the ordinal ``bar`` of each row within its case."""
    return led.withColumn("bar", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def diff(actual: DataFrame, reference: DataFrame, keys: Sequence[str], fields: Sequence[str], flags: Sequence[str] = (),
         rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """Per case and field: changed bars, the first of them and the largest difference.

    Numbers may differ by ``atol + rtol * |reference|``, flags must be equal, a
    bar present on one side only counts as changed. One co-partitioned join and
    one aggregate that combines on the map side.
    """
    names = [*fields, *flags]
    a = actual.select(*keys, "bar", F.struct(*names).alias("a"))
    b = reference.select(*keys, "bar", F.struct(*names).alias("b"))
    both = a.join(b, [*keys, "bar"], "full_outer")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"a.{n}").cast("double").alias("x"),
                               F.col(f"b.{n}").cast("double").alias("y"), F.lit(n in flags).alias("exact")) for n in names])
    rows = both.select(*keys, "bar", F.inline(pairs))
    near = F.when(F.col("exact"), F.col("x") == F.col("y")).otherwise(
        F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"))
    changed = ~F.coalesce(near, F.col("x").isNull() & F.col("y").isNull())
    return rows.withColumn("_ch", changed).groupBy(*keys, "field").agg(
        F.count_if("_ch").alias("changed_bars"), F.min(F.when(F.col("_ch"), F.col("bar")).cast("bigint")).alias("first_bar"),
        F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_delta"))


def metric_deltas(actual: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                  rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """Difference of each metric per case and whether it is outside tolerance."""
    both = actual.select(*keys, F.struct(*metrics).alias("a")).join(
        reference.select(*keys, F.struct(*metrics).alias("b")), list(keys), "full_outer")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("actual"),
                               F.col(f"b.{m}").cast("double").alias("expected")) for m in metrics])
    rows = both.select(*keys, F.inline(pairs))
    gap = F.abs(F.col("actual") - F.col("expected"))
    close = gap <= F.greatest(F.lit(atol), rtol * F.greatest(F.abs("actual"), F.abs("expected")))
    return rows.withColumns({"delta": F.col("actual") - F.col("expected"), "changed": ~F.coalesce(close, F.lit(False))})


def case_status(differences: DataFrame, keys: Sequence[str]) -> DataFrame:
    return differences.groupBy(*keys).agg(F.when(F.max("changed_bars") > 0, "changed").otherwise("passed").alias("status"))
