"""Writing results, stage tables, books and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null

RESULT_KEY = ("ticker", "strategy", "params")


def append_results(results: DataFrame, path: str, run: str) -> None:
    """Append one run (or stage) of results; a later run wins on equal keys when read back."""
    results.withColumns({"run": F.lit(run), "written_at": F.current_timestamp()}).write.mode("append").partitionBy(
        "run", "strategy").parquet(path)


def latest(rows: DataFrame, keys=RESULT_KEY, order: str = "written_at") -> DataFrame:
    """Last write wins, as a mergeable aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def read_results(spark: SparkSession, path: str, keys=RESULT_KEY) -> DataFrame:
    return latest(spark.read.parquet(path), keys)


def export_csv(df: DataFrame, path: str, order) -> None:
    """Ordered CSV export; arrays become JSON text. Range-partitioned, so the sort is global but not single-task."""
    flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes])
    flat.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def export_results(results: DataFrame, path: str) -> None:
    export_csv(results, path, ("strategy", "params", "ticker"))


def export_stages(stages: DataFrame, path: str) -> None:
    export_csv(stages, path, ("stage", "strategy", "params"))


def wide(legs: DataFrame, value: str, tickers, index: str = "date") -> DataFrame:
    """Date x asset view of a long table."""
    return legs.groupBy(index).pivot("ticker", list(tickers)).agg(F.first(value))


def export_book(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table of a portfolio book."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def jsonable(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null, as JSON has none."""
    return df.select(*[finite_or_null(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def write_summary(summary: DataFrame, path: str) -> None:
    jsonable(summary).write.mode("errorifexists").json(path)
