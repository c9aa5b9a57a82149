"""Reading, cleaning and publishing daily OHLCV bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_continuous, minus_business_days, next_business_day, previous_business_day

OHLC = ("open", "high", "low", "close")
REQUIRED = ("date",) + OHLC
BAR_SCHEMA = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLC]
    + [T.StructField("volume", T.DoubleType())]
)


class BarContractError(ValueError):
    """The stored table does not satisfy the daily-bar contract."""


def bars_from_trades(trades: DataFrame, ticker: Column, at: Column, price: Column, sequence: Column,
                     volume: Column | None = None) -> DataFrame:
    """Daily bars from individual trades: first/last by ``sequence``, extrema and volume.

    All five aggregates combine on the map side, so a ticker that holds a third
    of the feed ships one partial row per task and day, not its trades.
    """
    size = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)
    return (
        trades.select(ticker.alias("ticker"), at.cast("date").alias("date"), price.alias("p"), sequence.alias("s"),
                      *([] if volume is None else [volume.alias("v")]))
        .groupBy("ticker", "date")
        .agg(
            F.min_by("p", "s").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "s").alias("close"),
            (size if volume is None else F.sum("v").cast("double")).alias("volume"),
        )
    )


def read_ohlcv_csv(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Strict scan of one snapshot: fixed columns, ISO dates, numbers parsed as binary64.

    The header is case- and space-insensitive; a missing, unknown or duplicate
    column fails before any row is read, a malformed row fails the job.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [c.strip().lower() for c in header]
    if len(set(names)) != len(names):
        raise BarContractError("duplicate CSV columns")
    missing = sorted(set(REQUIRED) - set(names))
    unknown = sorted(set(names) - set(REQUIRED) - {"volume"})
    if missing or unknown:
        raise BarContractError(f"invalid CSV columns; missing={missing}, unknown={unknown}")
    schema = T.StructType([T.StructField(c, T.StringType() if n == "date" else T.DoubleType()) for c, n in zip(header, names, strict=True)])
    # without enforceSchema every file's own header is compared with the first one's
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path).toDF(*names)
    volume = F.col("volume") if "volume" in names else F.lit(None).cast("double")
    return strict_bars(raw.select(F.lit(ticker).alias("ticker"), "date", *OHLC, volume.alias("volume")))


def bar_row_problems(rows: DataFrame) -> DataFrame:
    """``problems`` of bars whose ``date`` is still text: dates that are no ISO session, repeated ones, prices and volumes out of order."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    price = F.lit(True)
    for c in OHLC:
        price = price & finite(F.col(c)) & (F.col(c) > 0)
    inside = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close"))
    volume = F.col("volume").isNull() | (finite(F.col("volume")) & (F.col("volume") >= 0))
    again = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*OHLC)) > 1
    rules = {"date": day.isNotNull(), "price": F.coalesce(price, F.lit(False)), "range": F.coalesce(inside, F.lit(True)), "volume": volume, "duplicate": ~again}
    flags = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumns({"problems": flags, "day": day})


def strict_bars(rows: DataFrame) -> DataFrame:
    """Bars with parsed dates; any row that breaks the contract fails the job and is named."""
    told = F.concat(F.lit("bar contract broken on "), F.coalesce("date", F.lit("null")), F.lit(": "), F.concat_ws(",", "problems"))
    day = F.when(F.size("problems") == 0, F.col("day")).otherwise(F.raise_error(told).cast("date"))
    return bar_row_problems(rows).withColumn("date", day).drop("problems", "day")


def bars_from_csv_lines(lines: DataFrame, ticker: str = "ticker", line: str = "line") -> DataFrame:
    """Data lines ``date,open,high,low,close,volume`` as text rows with their ``problems``; a cell that is no number is null."""
    cells = F.split(line, ",", -1)
    number = lambda i: F.get(cells, F.lit(i)).try_cast("double")
    rows = lines.select(F.col(ticker).alias("ticker"), F.trim(F.get(cells, F.lit(0))).alias("date"),
                        *[number(i + 1).alias(c) for i, c in enumerate((*OHLC, "volume"))])
    return bar_row_problems(rows)


def bars_from_json(df: DataFrame, ticker: str = "ticker", payload: str = "payload") -> DataFrame:
    """Bars stored as a JSON array of ``[date, open, high, low, close, volume]`` rows."""
    rows = df.select(
        F.col(ticker).alias("ticker"), F.explode(F.from_json(payload, "array<array<string>>")).alias("r")
    )
    cells = [F.get("r", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(OHLC + ("volume",))]
    return rows.select("ticker", F.get("r", F.lit(0)).cast("date").alias("date"), *cells)


def clean_provider_rows(raw: DataFrame, ingest_order: str, keys=("ticker",)) -> DataFrame:
    """Provider table to bars: keep the last ingested row per date, then drop rows without prices.

    The local session label is kept: a time zone is dropped, never converted.
    Volume may be missing. The last row is found with one mergeable aggregate.
    """
    lowered = raw.toDF(*[c.lower() for c in raw.columns])
    cols = [c for c in OHLC + ("volume",) if c in lowered.columns]
    kept = (
        lowered.withColumn("date", F.col("date").cast("date"))
        .groupBy(*keys, "date")
        .agg(F.max_by(F.struct(*cols), F.col(ingest_order.lower())).alias("row"))
        .select(*keys, "date", "row.*")
    )
    return kept.na.drop(subset=[c for c in OHLC if c in cols])


def slice_dates(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive date slice, pushed to the scan."""
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars


def with_price_fallback(bars: DataFrame) -> DataFrame:
    """Missing open/high/low fall back to the close."""
    have = set(bars.columns)
    return bars.withColumns(
        {c: F.coalesce(F.col(c), F.col("close")) if c in have else F.col("close") for c in ("open", "high", "low")}
    )


def publish_snapshot(bars: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write a snapshot to a new location, one directory per ticker; an existing one is never overwritten.

    Rows are spread over ``buckets`` files per ticker by year, so a large ticker
    is not written by a single task.
    """
    spread = F.year("date") if buckets is None else F.pmod(F.year("date"), F.lit(buckets))
    bars.repartition(F.col("ticker"), spread).sortWithinPartitions("ticker", "date").write.mode(
        "errorifexists"
    ).partitionBy("ticker").parquet(path)


def fingerprint(df: DataFrame, keys=("ticker",), columns=None) -> DataFrame:
    """Order-free content fingerprint per key: row count and xor of row digests."""
    columns = [c for c in (columns or df.columns) if c not in keys]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor(digest).alias("digest"))
        .withColumn("fingerprint", F.sha2(F.concat_ws(":", F.lit("|".join(columns)), "row_count", "digest"), 256))
    )


def range_coverage(bars: DataFrame, requests: DataFrame, today: Column | None = None) -> DataFrame:
    """Does the stored history of each ticker cover its requested range?

    ``requests`` has ``ticker, start, end`` and optionally ``earliest`` (known
    first listing date). A start may be late by seven days (holidays), or by more when the
    instrument is known to have been listed later; a historical end is strict
    and a near-current one has two sessions of slack.
    """
    today = F.current_date() if today is None else today
    stored = bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    if "earliest" not in requests.columns:
        requests = requests.withColumn("earliest", F.lit(None).cast("date"))
    always = is_continuous(F.col("ticker"))
    end = F.least(F.coalesce(F.col("end"), today), today)
    open_ended = F.col("end").isNull() | (F.col("end") >= F.date_sub(today, 2))
    start_edge = F.when(always, F.col("start")).otherwise(next_business_day(F.col("start")))
    slack = F.when(always, F.date_sub(end, 2)).otherwise(minus_business_days(end, 2))
    strict = F.when(always, end).otherwise(previous_business_day(end))
    late = F.coalesce(F.datediff("first_date", "start_edge") > 7, F.lit(True))
    listed_late = (
        F.col("earliest").isNotNull()
        & (F.col("start_edge") < F.col("earliest"))
        & (F.abs(F.datediff("first_date", "earliest")) <= 7)
    )
    return (
        requests.join(stored, "ticker", "left")
        .withColumn("start_edge", start_edge)
        .withColumn("end_edge", F.when(open_ended, slack).otherwise(strict))
        .withColumn("start_ok", ~late | F.coalesce(listed_late, F.lit(False)))
        .withColumn("end_ok", F.coalesce(F.col("last_date") >= F.col("end_edge"), F.lit(False)))
        .withColumn("covered", F.col("first_date").isNotNull() & F.col("start_ok") & F.col("end_ok"))
    )


def load_range(bars: DataFrame, ticker: str, start=None, end=None) -> DataFrame:
    """Inclusive slice of one ticker; fails when the requested end is not stored or nothing is left.

    An early start is allowed and yields what is stored. Only the two stored
    bounds come back to the driver, as one row of a pruned aggregate.
    """
    rows = bars.filter(F.col("ticker") == ticker)
    inside = slice_dates(rows, start, end)
    last = rows.agg(F.max("date")).first()[0]
    if last is None or inside.isEmpty():
        raise BarContractError(f"{ticker}: no bars in the requested range")
    if end is not None and str(last) < str(end):
        raise BarContractError(f"{ticker}: stored bars end on {last}, before the requested {end}")
    return inside

