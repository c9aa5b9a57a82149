"""Declared metadata: dataset manifests, membership histories and session calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALENDARS = ("exchange", "continuous")
ADJUSTMENTS = ("unadjusted", "split_adjusted", "split_and_dividend_adjusted")
MANIFEST_TEXT = ("dataset_id", "ticker", "source", "license", "currency", "calendar", "frequency",
                 "price_adjustment", "csv_file", "sha256")
MANIFEST_SCHEMA = T.StructType(
    [T.StructField("schema_version", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in MANIFEST_TEXT]
    + [T.StructField("annualization", T.DoubleType())]
)
MEMBERSHIP_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("universe_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("coverage_start", T.DateType()),
    T.StructField("coverage_end", T.DateType()),
    T.StructField("initial_known_on", T.DateType()),
    T.StructField("initial_members", T.ArrayType(T.StringType())),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("ticker", T.StringType()), T.StructField("known_on", T.DateType()),
        T.StructField("effective_on", T.DateType()), T.StructField("action", T.StringType())]))),
])
CALENDAR_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("calendar_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("coverage_start", T.DateType()),
    T.StructField("coverage_end", T.DateType()),
    T.StructField("sessions", T.ArrayType(T.DateType())),
])


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_dataset_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file under ``path``, with the list of broken rules."""
    return with_manifest_problems(_json(spark, path, MANIFEST_SCHEMA))


def manifest_rules() -> dict[str, Column]:
    """Rule name to the condition a declared dataset must satisfy."""
    c = F.col
    trimmed = [(c(n).isNotNull() & (F.length(c(n)).between(1, 2048)) & (F.trim(c(n)) == c(n))
                & ~c(n).rlike(r"[\x00-\x1f\x7f]")) for n in MANIFEST_TEXT]
    text_ok = trimmed[0]
    for t in trimmed[1:]:
        text_ok = text_ok & t
    return {
        "schema_version": c("schema_version") == 1,
        "text": text_ok,
        "dataset_id": c("dataset_id").rlike(r"^[A-Za-z0-9._-]{1,128}$"),
        "ticker": c("ticker").rlike(r"^[A-Z0-9._^=-]{1,64}$"),
        "currency": c("currency").rlike(r"^[A-Z]{3,12}$"),
        "calendar": c("calendar").isin(*CALENDARS),
        "frequency": c("frequency") == "1d",
        "price_adjustment": c("price_adjustment").isin(*ADJUSTMENTS),
        "annualization": (c("annualization") > 0) & (c("annualization") <= 366),
        "csv_file": c("csv_file").rlike(r"(?i)^[^/\\:]+\.csv$"),
        "sha256": c("sha256").rlike(r"^[a-f0-9]{64}$"),
    }


def with_manifest_problems(manifests: DataFrame) -> DataFrame:
    rules = manifest_rules()
    flags = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return manifests.withColumn("problems", F.array_compact(F.array(*flags)))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MEMBERSHIP_SCHEMA)


def membership_events(manifest: DataFrame) -> DataFrame:
    """Long table of dated changes."""
    return manifest.select("universe_id", "coverage_start", "coverage_end", F.explode("events").alias("e")).select(
        "universe_id", "coverage_start", "coverage_end", F.upper("e.ticker").alias("ticker"), "e.known_on",
        "e.effective_on", "e.action"
    )


def membership_opening(manifest: DataFrame) -> DataFrame:
    return manifest.select("universe_id", F.explode("initial_members").alias("t")).select(
        "universe_id", F.upper("t").alias("ticker")
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """One row per declared session, with the declared coverage."""
    return _json(spark, path, CALENDAR_SCHEMA).select(
        "calendar_id", "coverage_start", "coverage_end", F.explode("sessions").alias("date")
    )
