"""Data-quality checks. Each returns the violating rows, so an empty result means the table is clean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TICKER_PATTERN, finite
from ..sources.bars import OHLC, fingerprint

CONVENTIONS = ("currency", "calendar", "annualization", "price_adjustment")
SAMPLE_DATES = 10


def with_price_problems(bars: DataFrame) -> DataFrame:
    """Tag each row with its broken rules: non-positive or non-finite prices, inverted ranges, bad volume."""
    bad_price = F.lit(False)
    for c in OHLC:
        bad_price = bad_price | ~finite(F.col(c)) | F.coalesce(F.col(c) <= 0, F.lit(True))
    high = F.coalesce(F.col("high") < F.greatest("open", "low", "close"), F.lit(False))
    low = F.coalesce(F.col("low") > F.least("open", "high", "close"), F.lit(False))
    flags = [F.when(bad_price, F.lit("price")), F.when(high, F.lit("high")), F.when(low, F.lit("low"))]
    if "volume" in bars.columns:
        v = F.col("volume")
        flags.append(F.when(v.isNotNull() & (~finite(v) | (v < 0)), F.lit("volume")))
    return bars.withColumn("problems", F.array_compact(F.array(*flags)))


def price_violations(bars: DataFrame) -> DataFrame:
    return with_price_problems(bars).filter(F.size("problems") > 0)


def duplicate_dates(bars: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return bars.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def not_midnight(rows: DataFrame, at: str) -> DataFrame:
    return rows.filter(F.col(at) != F.date_trunc("day", at))


def out_of_order(rows: DataFrame, keys: Sequence[str], arrival: str, at: str, piece_rows: int = 1 << 16) -> DataFrame:
    """Rows that arrive with a date at or before the latest date already seen for their key.

    ``arrival`` is a whole number. Rows are checked in pieces of ``piece_rows`` arrival numbers; what a key has seen before a piece
    is a running maximum over the pieces' own, one row each, so that a key with half of all rows is spread over its pieces.
    """
    rows = rows.withColumn("_piece", F.floor(F.col(arrival) / piece_rows))
    pieces = rows.groupBy(*keys, "_piece").agg(F.max(at).alias("_seen"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), F.max("_seen").over(earlier).alias("_seen"))
    same = F.col("_piece").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_inside", F.max(at).over(inside)).join(pieces, same)
    seen = seen.withColumn("latest_before", F.greatest("_inside", "_seen")).filter(F.col(at) <= F.col("latest_before"))
    return seen.drop("_piece", "_inside", "_seen", "_p", *[f"_k{i}" for i in range(len(keys))])


def column_problems(columns: Sequence[str], optional: Sequence[str] = ("volume",)) -> dict[str, list[str]]:
    """Missing, unknown and duplicate column names of a bar table."""
    names = [c.strip().lower() for c in columns]
    required = ("date", *OHLC)
    return {
        "missing": sorted(set(required) - set(names)),
        "unknown": sorted(set(names) - set(required) - set(optional) - {"ticker"}),
        "duplicate": sorted({n for n in names if names.count(n) > 1}),
    }


# --- per-asset coverage -----------------------------------------------------------------------------------------------

def asset_metadata(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored and selected extents per requested asset, in one conditional aggregate."""
    inside = F.col("date").between(F.coalesce("start", F.lit("0001-01-01").cast("date")), F.coalesce("end", F.lit("9999-12-31").cast("date")))
    picked = F.when(inside, F.col("date"))
    joined = requests.join(bars.select("ticker", "date", "volume"), "ticker", "left")
    return joined.groupBy("ticker", "start", "end").agg(
        F.count("date").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count(picked).alias("selected_rows"), F.min(picked).alias("selected_first"), F.max(picked).alias("selected_last"),
        (F.count("volume") > 0).alias("has_volume"),
    )


def issue(df: DataFrame, code: str, severity: str, asset: str = "ticker", date=None) -> DataFrame:
    """Shape violations into the common issue form (code, severity, asset, date)."""
    day = F.lit(None).cast("date") if date is None else F.col(date) if isinstance(date, str) else date
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(asset).alias("asset"), day.alias("date"))


def range_issues(metadata: DataFrame) -> DataFrame:
    late = metadata.filter(F.col("start") < F.col("first_date"))
    cut = metadata.filter((F.col("end") > F.col("last_date")) | F.col("last_date").isNull())
    empty = metadata.filter(F.col("selected_rows") == 0)
    return issue(late, "late_start", "warning").unionByName(issue(cut, "truncated_end", "error")).unionByName(
        issue(empty, "empty_range", "error"))


def _spans(metadata: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested intervals with the coverage of the calendar that each asset names, and that calendar's days as one list.

    Three tables: intervals inside the coverage, intervals outside of it, and assets that name no calendar of the table.
    Tables without ``calendar_id`` mean one calendar. A list is bounded by the calendar; assets meet it through an equi-join.
    """
    day = F.lit("").alias("calendar_id")
    cal = calendar if "calendar_id" in calendar.columns else calendar.select("*", day)
    meta = metadata if "calendar_id" in metadata.columns else metadata.select("*", day)
    listed = cal.groupBy("calendar_id").agg(
        F.min("coverage_start").alias("_cl"), F.max("coverage_end").alias("_cr"), F.collect_set("date").alias("_days"))
    span = meta.withColumns({"_l": F.coalesce("start", "first_date"), "_r": F.coalesce("end", "last_date")}).join(listed, "calendar_id", "left")
    outside = (F.col("_l") < F.col("_cl")) | (F.col("_r") > F.col("_cr"))
    return span.filter(F.coalesce(~outside, F.lit(False))), span.filter(outside), span.filter("_days is null")


def expected_sessions(metadata: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Expected (ticker, date) rows: the asset's calendar inside its request, or every day of a continuous asset.

    An asset whose interval its calendar does not cover is reported by :func:`calendar_issues` and has no expected sessions, nor
    has one that names no known calendar, unless it is continuous.
    """
    every = lambda span: span.filter("calendar = 'continuous'").select("ticker", F.explode(F.sequence("_l", "_r")).alias("date"))
    if calendar is None:
        return every(metadata.select("ticker", "calendar", F.coalesce("start", "first_date").alias("_l"), F.coalesce("end", "last_date").alias("_r")))
    covered, _, unmatched = _spans(metadata, calendar)
    inside = F.filter("_days", lambda d: (d >= F.col("_l")) & (d <= F.col("_r")))
    listed = covered.select("ticker", F.explode(inside).alias("date"))
    return listed.unionByName(every(unmatched)) if "calendar" in metadata.columns else listed


def missing_sessions(expected: DataFrame, bars: DataFrame) -> DataFrame:
    return expected.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def unexpected_sessions(expected: DataFrame, bars: DataFrame, metadata: DataFrame) -> DataFrame:
    """Bars inside the requested interval of a checked asset that are no expected session."""
    span = metadata.select("ticker", F.coalesce("start", "first_date").alias("_l"), F.coalesce("end", "last_date").alias("_r"))
    checked = span.join(expected.select("ticker").distinct(), "ticker", "left_semi")
    inside = bars.select("ticker", "date").join(checked, "ticker").filter(F.col("date").between(F.col("_l"), F.col("_r")))
    return inside.select("ticker", "date").join(expected, ["ticker", "date"], "left_anti")


def calendar_issues(metadata: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Coverage of the calendar, conflict with a continuous declaration, or no calendar to verify with."""
    if calendar is None:
        return issue(metadata.filter("calendar <> 'continuous'"), "calendar_unverified", "warning")
    covered, outside, unmatched = _spans(metadata, calendar)
    held = F.size(F.filter("_days", lambda d: (d >= F.col("_l")) & (d <= F.col("_r"))))
    days = F.greatest(F.datediff("_r", "_l") + 1, F.lit(0))
    conflict = covered.filter((F.col("calendar") == "continuous") & (held != days))
    return (issue(outside, "calendar_coverage", "error").unionByName(issue(conflict, "calendar_declaration_conflict", "error"))
            .unionByName(issue(unmatched.filter("calendar <> 'continuous'"), "calendar_unverified", "warning")))


# --- across assets ----------------------------------------------------------------------------------------------------

def adjustment_risk(assets: DataFrame) -> DataFrame:
    return issue(assets.filter("price_adjustment <> 'split_and_dividend_adjusted'"), "adjustment_risk", "warning")


def convention_mismatch(assets: DataFrame) -> DataFrame:
    """Declared conventions that differ from the first asset by ticker (one row per asset and field)."""
    lead = assets.agg(F.min_by(F.struct("ticker", *CONVENTIONS), "ticker").alias("ref"))
    both = assets.join(F.broadcast(lead), F.lit(True))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"),
                                F.col(f"ref.{c}").cast("string").alias("expected")) for c in CONVENTIONS])
    return both.select("ticker", F.inline(fields)).filter(~F.col("value").eqNullSafe(F.col("expected")))


def session_mismatch(bars: DataFrame) -> DataFrame:
    """Dates that an asset and the first asset by ticker do not share.

    A ticker's date set is bounded by the calendar, so each is one array; the
    reference set is a single row, and both differences are array functions.
    """
    sets = bars.groupBy("ticker").agg(F.collect_set("date").alias("_own"))
    lead = sets.agg(F.min_by(F.struct(F.col("ticker").alias("_ref"), F.col("_own").alias("_days")), "ticker").alias("r")).select("r.*")
    both = sets.join(F.broadcast(lead), F.lit(True)).filter(F.col("ticker") != F.col("_ref"))
    kinds = F.array(F.struct(F.lit("extra").alias("kind"), F.array_except("_own", "_days").alias("_d")),
                    F.struct(F.lit("absent").alias("kind"), F.array_except("_days", "_own").alias("_d")))
    return both.select("ticker", F.inline(kinds)).select("ticker", F.explode("_d").alias("date"), "kind")


def insufficient_history(bars: DataFrame, lookback: int, assets: DataFrame | None = None) -> DataFrame:
    """Assets with too few rows; those of ``assets`` (column ticker) without any row are among them."""
    counts = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    if assets is not None:
        counts = assets.select("ticker").distinct().join(counts, "ticker", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
    return counts.filter(F.col("rows") < lookback + 2)


def identical_files(bars: DataFrame, columns=OHLC) -> DataFrame:
    """Assets whose whole price history equals that of an earlier ticker."""
    prints = fingerprint(bars.select("ticker", "date", *columns))
    first = prints.groupBy("fingerprint").agg(F.min("ticker").alias("same_as"))
    return prints.join(first, "fingerprint").filter(F.col("ticker") != F.col("same_as")).select("ticker", "same_as")


def ticker_problems(names: DataFrame, column: str = "ticker") -> DataFrame:
    """Names that are no canonical ticker, or that collide when upper-cased."""
    aliases = names.groupBy(F.upper(column).alias("canonical")).agg(
        F.countDistinct(column).alias("spellings"), F.min(column).alias("example"),
        F.min(F.col(column).rlike(TICKER_PATTERN).cast("int")).alias("_ok"))
    return aliases.filter((F.col("spellings") > 1) | (F.col("_ok") == 0)).select(
        "canonical", "spellings", "example", (F.col("_ok") == 1).alias("well_formed"))


def grid_contract(bars: DataFrame) -> DataFrame:
    """Dates on which not every asset has a finite positive close."""
    width = bars.agg(F.countDistinct("ticker").alias("_width"))
    good = finite(F.col("close")) & (F.col("close") > 0)
    per_day = bars.groupBy("date").agg(F.count_if(good).alias("valid"), F.count(F.lit(1)).alias("rows"))
    return per_day.join(F.broadcast(width), F.lit(True)).filter((F.col("valid") != F.col("_width")) | (F.col("rows") != F.col("_width"))).drop("_width")


def load_contract(assets: DataFrame, bars: DataFrame, lookback: int) -> DataFrame:
    """All cross-asset requirements of a portfolio load as one issue table."""
    a = issue(convention_mismatch(assets), "convention_mismatch", "error")
    b = issue(session_mismatch(bars), "session_mismatch", "error", date="date")
    c = issue(insufficient_history(bars, lookback, assets), "insufficient_history", "error")
    return a.unionByName(b).unionByName(c)


def target_problems(targets: DataFrame, width: int) -> DataFrame:
    """Instruction dates whose weights are incomplete, negative or sum above one."""
    w = F.col("weight")
    rows = targets.groupBy("date").agg(
        F.count_if(finite(w)).alias("assets"), F.min("weight").alias("lowest"), F.sum("weight").alias("total"))
    return rows.filter((F.col("assets") != width) | (F.col("lowest") < 0) | (F.col("total") > 1 + 1e-12))


def normalised_targets(targets: DataFrame) -> DataFrame:
    """Rounding overshoot is scaled back to one; empty slots are never scaled up."""
    w = Window.partitionBy("date")
    return targets.withColumn("weight", F.col("weight") / F.greatest(F.lit(1.0), F.sum("weight").over(w)))


def membership_rollup(bars: DataFrame, problems: DataFrame, key: str = "book") -> DataFrame:
    """One issue at most for each ``key``: membership can't be checked unless all assets have the same sessions, and some;
    if they do, any of ``problems`` makes it invalid. Keys come from ``bars``; a missing session is told by counting."""
    state = bars.groupBy(key).agg(F.count("date").alias("_rows"), F.countDistinct("date").alias("_days"), F.countDistinct("ticker").alias("_width"),
                                  F.countDistinct("ticker", "date").alias("_cells"))
    found = problems.groupBy(key).agg(F.count(F.lit(1)).alias("_bad"))
    aligned = (F.col("_rows") > 0) & (F.col("_rows") == F.col("_cells")) & (F.col("_cells") == F.col("_days") * F.col("_width"))
    code = F.when(~aligned, "membership_not_checked").when(F.col("_bad") > 0, "invalid_membership")
    return state.join(found, key, "left").select(
        code.alias("code"), F.lit("error").alias("severity"), F.col(key).alias("asset"), F.lit(None).cast("date").alias("date")).filter("code is not null")


# --- report -----------------------------------------------------------------------------------------------------------

def issue_report(issues: DataFrame) -> DataFrame:
    """Count and at most ten first dates per (code, asset).

    The dates are first cut to ten per group by a windowed rank, whose limit
    Spark applies before the shuffle, so no unbounded list is collected.
    """
    counts = issues.groupBy("code", "severity", "asset").agg(F.count("date").alias("dates"))
    w = Window.partitionBy("code", "asset").orderBy("date")
    few = (
        issues.filter(F.col("date").isNotNull()).withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= SAMPLE_DATES)
        .groupBy("code", "asset").agg(F.sort_array(F.collect_list("date")).alias("sample_dates"))
    )
    return counts.join(few, ["code", "asset"], "left")


def report_status(report: DataFrame) -> DataFrame:
    """One row: errors, warnings and the overall status."""
    errors = F.count_if(F.col("severity") == "error")
    return report.agg(
        errors.alias("error_count"), (F.count(F.lit(1)) - errors).alias("warning_count"),
        F.when(errors > 0, "error").when(F.count(F.lit(1)) > 0, "warning").otherwise("passed").alias("status"))


# --- result snapshots -------------------------------------------------------------------------------------------------

def snapshot_problems(ledger: DataFrame, expected: DataFrame, fields: Sequence[str], keys=("case_id",)) -> DataFrame:
    """Missing or unexpected cases, wrong bar counts and non-finite values of a stored result set."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | ~finite(F.col(f))
    got = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows"))
    both = expected.select(*keys, "bars").join(got, list(keys), "full_outer")
    problem = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("bars").isNull(), "unexpected")
        .when(F.col("rows") != F.col("bars"), "length").when(F.col("bad_rows") > 0, "non_finite")
    )
    return both.withColumn("problem", problem).filter("problem is not null")
