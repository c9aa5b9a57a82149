"""Cross-sectional momentum: signals, targets and a self-financing long-only book.

Tables are long: prices and targets are (book, date, ticker) rows, and a date
without target rows means HOLD. ``book`` identifies an account; many run at once.

The unrestricted book needs no bar-by-bar recursion. After every instruction
the holdings equal the target exactly, so between two instructions the account
only depends on the last target: the growth since then is one aggregate over
the legs, the instruction's cost shrinks the account by the root of a piecewise
linear equation, and the NAV is a running product over dates. A turnover budget
leaves holdings short of the target and therefore walks its instructions in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .membership import with_membership_change
from .walks import run_budgeted_book

KEYS = ("book",)


@dataclass(frozen=True)
class MomentumOptions:
    lookback: int = 126
    skip_recent: int = 0
    top_k: int = 1
    rebalance: str = "monthly"
    absolute_threshold: float | None = 0.0
    max_weight: float = 1.0

    def __post_init__(self):
        if self.lookback < 1 or not 0 <= self.skip_recent < self.lookback:
            raise ValueError("require 0 <= skip_recent < lookback")
        if self.top_k < 1 or not 0 < self.max_weight <= 1:
            raise ValueError("require top_k >= 1 and max_weight in (0, 1]")
        if self.rebalance not in ("daily", "weekly", "monthly"):
            raise ValueError("rebalance must be daily, weekly or monthly")


@dataclass(frozen=True)
class ExecutionOptions:
    initial_capital: float = 1_000_000.0
    cost_bps: float = 1.0
    slippage_bps: float = 0.0
    spread_bps: float = 0.0
    cash_rate: float = 0.0
    execution_lag: int = 1
    max_turnover: float | None = None

    def __post_init__(self):
        if self.initial_capital <= 0 or self.cash_rate <= -1 or self.execution_lag < 1:
            raise ValueError("require positive capital, cash_rate > -1 and execution_lag >= 1")
        if min(self.cost_bps, self.slippage_bps, self.spread_bps) < 0 or self.rate >= 1:
            raise ValueError("costs must be non-negative and below 10000 bps in total")
        if self.max_turnover is not None and not 0 <= self.max_turnover <= 2:
            raise ValueError("max_turnover must be in [0, 2]")

    @property
    def rate(self) -> float:
        return (self.cost_bps + self.slippage_bps + self.spread_bps / 2) / 10000.0


def with_book(df: DataFrame, name: str = "all") -> DataFrame:
    return df if "book" in df.columns else df.withColumn("book", F.lit(name))


def sessions(prices: DataFrame) -> DataFrame:
    """Distinct dates per book with their ordinal ``_n``: as long as the calendar."""
    days = prices.select("book", "date").distinct()
    return days.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy("date")) - 1)


def scores(prices: DataFrame, opts: MomentumOptions, eligibility: DataFrame | None = None) -> DataFrame:
    """``P[t-skip] / P[t-lookback] - 1`` per leg; NULL while unknown or while the asset is not a member."""
    w = Window.partitionBy("book", "ticker").orderBy("date")
    recent = F.lag("close", opts.skip_recent).over(w) if opts.skip_recent else F.col("close")
    out = prices.select("book", "date", "ticker", (recent / F.lag("close", opts.lookback).over(w) - 1).alias("score"))
    if eligibility is None:
        return out
    member = eligibility.select("date", "ticker", "eligible")
    return out.join(member, ["date", "ticker"]).select(
        "book", "date", "ticker", F.when(F.col("eligible"), F.col("score")).alias("score"))


def signal_dates(prices: DataFrame, opts: MomentumOptions, eligibility: DataFrame | None = None) -> DataFrame:
    """Every session with ``scheduled``: first of its week or month, any membership change, or end of warm-up."""
    s = sessions(prices)
    w = Window.partitionBy("book").orderBy("date")
    if opts.rebalance == "daily":
        flag = F.lit(True)
    else:
        unit = F.date_trunc("month" if opts.rebalance == "monthly" else "week", "date")
        flag = F.coalesce(unit != F.lag(unit).over(w), F.lit(True))
    s = s.withColumn("_flag", flag)
    if eligibility is not None:
        changed = with_membership_change(eligibility).groupBy("date").agg(F.max("changed").alias("_changed"))
        s = s.join(changed, "date", "left").withColumn("_flag", F.col("_flag") | F.coalesce("_changed", F.lit(False)))
    scheduled = F.when(F.col("_n") < opts.lookback, False).when(F.col("_n") == opts.lookback, True).otherwise(F.col("_flag"))
    return s.select("book", "date", "_n", scheduled.alias("scheduled"))


def momentum_targets(prices: DataFrame, opts: MomentumOptions, eligibility: DataFrame | None = None) -> DataFrame:
    """Target rows on signal dates only: the best ``top_k`` assets above the threshold get one slot each.

    Empty slots stay in cash. Ties break by ticker.
    """
    on = signal_dates(prices, opts, eligibility).filter("scheduled").select("book", "date")
    df = scores(prices, opts, eligibility).join(on, ["book", "date"])
    rank = F.row_number().over(Window.partitionBy("book", "date").orderBy(F.desc_nulls_last("score"), "ticker"))
    keep = F.col("score").isNotNull()
    if opts.absolute_threshold is not None:
        keep = keep & (F.col("score") > opts.absolute_threshold)
    slot = min(1.0 / opts.top_k, opts.max_weight)
    return df.withColumn("_rank", rank).select(
        "book", "date", "ticker", F.when(keep & (F.col("_rank") <= opts.top_k), slot).otherwise(0.0).alias("weight"), "score")


def benchmark_targets(prices: DataFrame, opts: MomentumOptions, eligibility: DataFrame | None = None) -> DataFrame:
    """Equal weights once at the first signal, or over the members at every signal."""
    on = signal_dates(prices, opts, eligibility).filter("scheduled")
    if eligibility is None:
        first = on.groupBy("book").agg(F.min("date").alias("date"))
        legs = prices.join(first, ["book", "date"])
        n = F.count(F.lit(1)).over(Window.partitionBy("book", "date"))
        return legs.select("book", "date", "ticker", F.least(1.0 / n, F.lit(opts.max_weight)).alias("weight"))
    legs = prices.join(on, ["book", "date"]).join(eligibility.select("date", "ticker", "eligible"), ["date", "ticker"])
    n = F.sum(F.col("eligible").cast("int")).over(Window.partitionBy("book", "date"))
    return legs.select("book", "date", "ticker",
                       F.when(F.col("eligible"), F.least(1.0 / n, F.lit(opts.max_weight))).otherwise(0.0).alias("weight"))


def _scheduled_legs(targets: DataFrame, prices: DataFrame, lag: int) -> DataFrame:
    """Legs on every session with ``w_new``: the normalised weight of the instruction executed on that date."""
    s = sessions(prices)
    total = F.sum("weight").over(Window.partitionBy("book", "date"))
    t = targets.withColumn("_w", F.col("weight") / F.greatest(F.lit(1.0), total))
    orders = (
        t.join(s, ["book", "date"]).select("book", "ticker", (F.col("_n") + lag).alias("_n"), F.col("_w").alias("w_new"))
        .join(s, ["book", "_n"]).select("book", "date", "ticker", "w_new")
    )
    return prices.select("book", "date", "ticker", "close").join(orders, ["book", "date", "ticker"], "left")


def book(targets: DataFrame, prices: DataFrame, opts: ExecutionOptions) -> tuple[DataFrame, DataFrame]:
    """``(nav, legs)``: one row per (book, date) and one per (book, date, ticker)."""
    if opts.max_turnover is not None:
        return _budgeted(targets, prices, opts)
    k, growth = opts.rate, 1.0 + opts.cash_rate
    legs = _scheduled_legs(targets, prices, opts.execution_lag)
    w = Window.partitionBy("book", "ticker").orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ordered = F.col("w_new").isNotNull()
    legs = legs.withColumns({
        "w_old": F.last("w_new", ignorenulls=True).over(past),
        "_p_old": F.last(F.when(ordered, F.col("close")), ignorenulls=True).over(past),
        "_d_old": F.last(F.when(ordered, F.col("date")), ignorenulls=True).over(past),
        "_p_prev": F.lag("close").over(w), "_d_prev": F.lag("date").over(w), "_d_first": F.min("date").over(w),
    })
    held = F.coalesce(F.col("w_old") * F.col("close") / F.col("_p_old"), F.lit(0.0))
    legs = legs.withColumns({"_v": held, "_pnl": F.coalesce(F.col("w_old") * (F.col("close") - F.col("_p_prev")) / F.col("_p_old"), F.lit(0.0))})
    per_day = legs.groupBy("book", "date").agg(
        F.sum("_v").alias("_assets"), F.sum("_pnl").alias("_pnl"), (1 - F.coalesce(F.sum("w_old"), F.lit(0.0))).alias("_c"),
        F.coalesce(F.max("_d_old"), F.max("_d_first")).alias("_since"), F.max("_d_prev").alias("_d_prev"),
        (F.count("w_new") > 0).alias("executed"), F.sum("w_new").alias("_w_new"))
    held_for = F.pow(F.lit(growth), F.datediff("date", "_since") / 365.0)
    prior = F.pow(F.lit(growth), F.datediff("_d_prev", "_since") / 365.0)
    per_day = per_day.withColumns({"_cash": F.col("_c") * held_for, "_interest": F.coalesce(F.col("_c") * (held_for - prior), F.lit(0.0))})
    per_day = per_day.withColumn("_g", F.col("_assets") + F.col("_cash"))
    trading = legs.filter(ordered).join(per_day.filter("executed").select("book", "date", "_g"), ["book", "date"])
    shrink = _post_cost(trading.withColumn("_share", F.col("_v") / F.col("_g")), k)
    per_day = per_day.join(shrink, ["book", "date"], "left")
    line = Window.partitionBy("book").orderBy("date")
    step = F.when(F.col("executed"), F.log(F.col("_g") * F.col("_x")))
    base = F.lit(opts.initial_capital) * F.exp(F.coalesce(F.sum(step).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    nav = per_day.withColumn("_base", base)
    nav = nav.withColumn("pre_trade_nav", F.col("_base") * F.col("_g"))
    nav = nav.withColumn("nav", F.when(F.col("executed"), F.col("pre_trade_nav") * F.col("_x")).otherwise(F.col("pre_trade_nav")))
    cash = F.when(F.col("executed"), (1 - F.col("_w_new")) * F.col("nav")).otherwise(F.col("_base") * F.col("_cash"))
    nav = nav.withColumns({
        "cash": F.greatest(cash, F.lit(0.0)), "asset_pnl": F.col("_pnl") * F.col("_base"), "cash_interest": F.col("_interest") * F.col("_base"),
        "traded_notional": F.coalesce(F.col("_turn") * F.col("pre_trade_nav"), F.lit(0.0)), "turnover": F.coalesce("_turn", F.lit(0.0)),
        "transaction_cost": F.coalesce(F.col("_turn") * F.col("pre_trade_nav") * k, F.lit(0.0)),
        "fill_fraction": F.col("executed").cast("double"), "turnover_limited": F.lit(False)})
    nav = nav.withColumns({"requested_notional": F.col("traded_notional"), "unfilled_notional": F.lit(0.0)})
    day = nav.select("book", "date", F.col("nav").alias("_nav"), F.col("pre_trade_nav").alias("_pre"), "_g", "_x")
    out = legs.join(day, ["book", "date"])
    weight = F.when(ordered, F.col("w_new")).otherwise(F.col("_v") / F.col("_g"))
    trade = F.when(ordered, (F.col("w_new") * F.col("_x") - F.col("_v") / F.col("_g")) * F.col("_pre")).otherwise(0.0)
    out = out.withColumns({"weight": weight, "asset_value": weight * F.col("_nav"), "units": weight * F.col("_nav") / F.col("close"),
                           "trade": trade, "requested_trade": trade, "unfilled_trade": F.lit(0.0), "executed_target": F.col("w_new")})
    return _nav_columns(nav, opts), out.select(*LEG_COLUMNS)


LEG_COLUMNS = ("book", "date", "ticker", "close", "weight", "units", "asset_value", "trade", "requested_trade", "unfilled_trade", "executed_target")
NAV_COLUMNS = ("book", "date", "nav", "equity", "cash", "cash_weight", "asset_pnl", "cash_interest", "pre_trade_nav", "transaction_cost",
               "traded_notional", "turnover", "gross_return", "net_return", "rebalance_executed", "requested_notional", "unfilled_notional",
               "fill_fraction", "turnover_limited")


def _nav_columns(nav: DataFrame, opts: ExecutionOptions) -> DataFrame:
    before = F.coalesce(F.lag("nav").over(Window.partitionBy("book").orderBy("date")), F.lit(float(opts.initial_capital)))
    return nav.withColumns({
        "equity": F.col("nav") / opts.initial_capital, "cash_weight": F.col("cash") / F.col("nav"),
        "gross_return": F.col("pre_trade_nav") / before - 1, "net_return": F.col("nav") / before - 1,
        "rebalance_executed": F.col("executed")}).select(*NAV_COLUMNS)


def _post_cost(legs: DataFrame, k: float) -> DataFrame:
    """Per (book, date): ``_x`` with ``x + k * sum|w x - share| = 1`` and the traded fraction ``_turn``.

    The left side is increasing and linear between the points share/w, so the
    legs are ordered by that point, the last one not beyond the root fixes who
    buys and who sells, and the root is closed form. Two aggregates, no
    iteration and no array of legs.
    """
    buys = F.col("w_new") > 0
    point = F.when(buys, F.col("_share") / F.col("w_new"))
    order = Window.partitionBy("book", "date").orderBy(F.asc_nulls_last("_b"), "ticker").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("book", "date")
    df = legs.withColumn("_b", point).withColumns({
        "_cw": F.sum(F.when(buys, F.col("w_new")).otherwise(0.0)).over(order), "_cv": F.sum(F.when(buys, F.col("_share")).otherwise(0.0)).over(order),
        "_tw": F.sum(F.when(buys, F.col("w_new")).otherwise(0.0)).over(whole), "_tv": F.sum(F.when(buys, F.col("_share")).otherwise(0.0)).over(whole),
        "_t0": F.sum(F.when(buys, 0.0).otherwise(F.col("_share"))).over(whole)})
    b = F.col("_b")
    at = b + k * ((F.col("_cw") * b - F.col("_cv")) + (F.col("_tv") - F.col("_cv")) - (F.col("_tw") - F.col("_cw")) * b) + k * F.col("_t0")
    inside = F.coalesce(buys & (at <= 1), F.lit(False))
    root = df.groupBy("book", "date").agg(
        F.coalesce(F.max(F.when(inside, F.col("_cw"))), F.lit(0.0)).alias("_a"), F.coalesce(F.max(F.when(inside, F.col("_cv"))), F.lit(0.0)).alias("_bv"),
        F.max("_tw").alias("_tw"), F.max("_tv").alias("_tv"), F.max("_t0").alias("_t0"))
    x = (1 + k * F.col("_bv") - k * (F.col("_tv") - F.col("_bv")) - k * F.col("_t0")) / (1 + k * F.col("_a") - k * (F.col("_tw") - F.col("_a")))
    root = root.select("book", "date", x.alias("_x"))
    traded = legs.join(root, ["book", "date"]).groupBy("book", "date").agg(
        F.sum(F.abs(F.col("w_new") * F.col("_x") - F.col("_share"))).alias("_turn"))
    return root.join(traded, ["book", "date"])


def _budgeted(targets: DataFrame, prices: DataFrame, opts: ExecutionOptions) -> tuple[DataFrame, DataFrame]:
    """Turnover-budgeted account: one sequential walk per book over its (date x asset) matrix.

    The holdings after each instruction depend on how much of the previous one
    was filled, so a book is the unit of work: one task holds a whole book
    (dates x assets rows) and nothing checks its size. Books run in parallel.
    """
    legs = _scheduled_legs(targets, prices, opts.execution_lag)
    doubles = ("weight", "units", "asset_value", "trade", "requested_trade", "unfilled_trade", "nav", "cash", "asset_pnl", "cash_interest",
               "pre_trade_nav", "transaction_cost", "traded_notional", "turnover", "requested_notional", "unfilled_notional", "fill_fraction")
    schema = T.StructType([*[f for f in legs.schema.fields], *[T.StructField(d, T.DoubleType()) for d in doubles],
                           T.StructField("turnover_limited", T.BooleanType()), T.StructField("executed", T.BooleanType())])
    names = legs.columns

    def walk(pdf):
        pdf = pdf.sort_values(["date", "ticker"], kind="stable")
        dates = pdf["date"].unique()
        m = len(pdf) // len(dates)
        if m * len(dates) != len(pdf):
            raise ValueError("every session needs every asset")
        shape = (len(dates), m)
        days = [0.0, *[float((b - a).days) for a, b in zip(dates, dates[1:])]]
        result = run_budgeted_book(pdf["close"].to_numpy().reshape(shape), pdf["w_new"].to_numpy(dtype=float).reshape(shape), days, opts)
        out = pdf[names].copy()
        for name, values in result.items():
            out[name] = values.reshape(-1)
        return out

    rows = legs.groupBy("book").applyInPandas(walk, schema)
    nav = rows.groupBy("book", "date").agg(*[F.max(c).alias(c) for c in (*doubles[6:], "turnover_limited", "executed")])
    return _nav_columns(nav, opts), rows.withColumn("executed_target", F.col("w_new")).select(*LEG_COLUMNS)


def metrics(nav: DataFrame, annualization: float = 252.0, risk_free_rate: float = 0.0) -> DataFrame:
    """Whole-history metrics per book; the structural first row has no return."""
    line = Window.partitionBy("book").orderBy("date")
    df = nav.withColumns({"_i": F.row_number().over(line), "_peak": F.greatest(F.max("equity").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))})
    r = F.when(F.col("_i") > 1, F.col("net_return"))
    agg = df.groupBy("book").agg(
        F.count(r).alias("return_intervals"), F.max_by("nav", "date").alias("final_nav"), F.max_by("equity", "date").alias("_eq"),
        F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"),
        F.sum("transaction_cost").alias("transaction_costs"), F.sum("traded_notional").alias("traded_notional"), F.sum("turnover").alias("turnover"),
        F.count_if("rebalance_executed").alias("rebalances"), F.avg("cash_weight").alias("average_cash_weight"),
        F.sum("requested_notional").alias("requested_notional"), F.sum("unfilled_notional").alias("unfilled_notional"),
        F.count_if("turnover_limited").alias("limited_rebalances"))
    vol = F.when(F.col("return_intervals") >= 2, F.col("_std") * F.sqrt(F.lit(float(annualization))))
    agg = agg.withColumn("volatility", vol)
    return agg.withColumns({
        "total_return": F.col("_eq") - 1,
        "cagr": F.when(F.col("return_intervals") > 0, F.expm1(F.log("_eq") * annualization / F.greatest("return_intervals", F.lit(1)))),
        "sharpe": F.when(F.col("volatility") > 1e-12, (F.col("_mean") * annualization - risk_free_rate) / F.col("volatility")),
    }).drop("_eq", "_mean", "_std")


def summary(nav: DataFrame, legs: DataFrame, targets: DataFrame) -> DataFrame:
    """Final weights next to the last signal's targets and scores, with the dates of the last signal and fill."""
    ends = nav.groupBy("book").agg(
        F.max("date").alias("_end"), F.max(F.when(F.col("rebalance_executed"), F.col("date"))).alias("last_execution_date"),
        F.max_by("cash_weight", "date").alias("latest_cash_weight"))
    last = targets.groupBy("book").agg(F.max("date").alias("last_signal_date"))
    final = legs.join(ends, "book").filter(F.col("date") == F.col("_end")).select(
        "book", "ticker", F.col("weight").alias("latest_weight"), "latest_cash_weight", "last_execution_date")
    score = F.col("score") if "score" in targets.columns else F.lit(None).cast("double")
    signal = targets.join(last, "book").filter(F.col("date") == F.col("last_signal_date")).select(
        "book", "ticker", "last_signal_date", F.col("weight").alias("last_target"), score.alias("last_score"))
    return final.join(signal, ["book", "ticker"], "left")


def rebase(nav: DataFrame, legs: DataFrame, anchor) -> tuple[DataFrame, DataFrame]:
    """Both tables from the anchor date on: equity restarts at 1 and the anchor row carries no flow."""
    day = F.lit(anchor).cast("date") if not hasattr(anchor, "isNull") else anchor
    line = Window.partitionBy("book").orderBy("date")
    kept = nav.filter(F.col("date") >= day).withColumn("_start", F.first("nav").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("date") == day
    flows = ("asset_pnl", "cash_interest", "transaction_cost", "traded_notional", "turnover", "gross_return", "net_return",
             "requested_notional", "unfilled_notional", "fill_fraction")
    kept = kept.withColumns({
        "equity": F.col("nav") / F.col("_start"), **{c: F.when(at, 0.0).otherwise(F.col(c)) for c in flows},
        "pre_trade_nav": F.when(at, F.col("nav")).otherwise(F.col("pre_trade_nav")),
        "rebalance_executed": F.col("rebalance_executed") & ~at, "turnover_limited": F.col("turnover_limited") & ~at}).drop("_start")
    parts = legs.filter(F.col("date") >= day)
    parts = parts.withColumns({**{c: F.when(at, 0.0).otherwise(F.col(c)) for c in ("trade", "requested_trade", "unfilled_trade")},
                               "executed_target": F.when(~at, F.col("executed_target"))})
    return kept, parts


def study_boundary(prices: DataFrame, test_start, lookback: int) -> DataFrame:
    """Per book: the anchor (last development session), or why the split is not allowed."""
    day = F.lit(test_start).cast("date")
    per = sessions(prices).groupBy("book").agg(
        F.count_if(F.col("date") < day).alias("development"), F.count_if(F.col("date") >= day).alias("test"),
        F.max(F.when(F.col("date") < day, F.col("date"))).alias("anchor"), F.max((F.col("date") == day).cast("int")).alias("_hit"))
    why = (F.when(F.col("_hit") == 0, "test_start is no session").when(F.col("development") < lookback + 2, "too little development history")
           .when(F.col("test") < 2, "too few test sessions"))
    return per.withColumn("problem", why).drop("_hit")
