"""Target weights and prices to realised profit and loss.

Two forms of the same account. With costs proportional to the traded amount
every trade reaches its target exactly, so the weight carried into a bar is the
previous executed target: the ledger is a set of window columns, evaluated for
all (ticker, candidate) groups at once. A minimum fee, market impact or a
participation cap makes the next bar depend on the filled amount; that form
walks the bars in order, vectorised over the candidates of a group.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as k
from ..functions.scalars import annualization
from .arrays import over_bars
from .fills import run_account
from .schedules import accrual, as_of, constant_accrual

NO_TRADE = 1e-14


@dataclass(frozen=True)
class LedgerOptions:
    cost_bps: float = 1.0
    slippage_bps: float = 0.0
    spread_bps: float = 0.0
    vol_target: float | None = None
    vol_lookback: int = 21
    max_leverage: float = 2.0
    execution_lag: int = 0
    price: str = "close"
    cash_rate: float = 0.0
    financing_rate: float = 0.0
    financing_spread: float = 0.0
    borrow_bps: float = 0.0
    short_rebate_rate: float = 0.0
    impact_bps: float = 0.0
    impact_exponent: float = 0.5
    impact_reference_participation: float = 0.01
    max_participation: float | None = None
    initial_capital: float = 1_000_000.0
    min_fee: float = 0.0

    def __post_init__(self):
        for name in ("cost_bps", "slippage_bps", "spread_bps", "impact_bps", "min_fee", "financing_rate",
                     "financing_spread", "borrow_bps"):
            if not 0 <= getattr(self, name) < float("inf"):
                raise ValueError(f"{name}: expected a number from 0 up, got {getattr(self, name)}")
        for name in ("max_leverage", "initial_capital", "impact_exponent"):
            if not 0 < getattr(self, name) < float("inf"):
                raise ValueError(f"{name}: expected a number above 0, got {getattr(self, name)}")
        for name in ("cash_rate", "short_rebate_rate"):
            if not getattr(self, name) > -1:
                raise ValueError(f"{name}: a rate loses less than everything, got {getattr(self, name)}")
        if not 0 < self.impact_reference_participation <= 1:
            raise ValueError("impact_reference_participation is a share of the volume, above 0 and at most 1")
        if self.max_participation is not None and not 0 < self.max_participation <= 1:
            raise ValueError("max_participation is a share of the volume, above 0 and at most 1, or None")
        if self.execution_lag < 0 or int(self.execution_lag) != self.execution_lag:
            raise ValueError(f"execution_lag counts whole bars, got {self.execution_lag}")
        if self.vol_target is not None and (self.vol_target < 0 or self.vol_lookback < 2):
            raise ValueError("vol_target can't be below 0, and a volatility needs a vol_lookback of two returns or more")

    @property
    def proportional(self) -> bool:
        return self.impact_bps == 0 and self.max_participation is None and self.min_fee == 0


MARKET = ("m_ret", "m_cash", "m_fin", "m_borrow", "m_rebate", "m_spread", "m_ok", "m_ok_prev", "m_scale", "m_price",
          "m_volume", "ann")


def with_market(bars: DataFrame, opts: LedgerOptions, schedules: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per-bar inputs of the ledger that do not depend on the candidate.

    ``schedules`` may replace any of cash_rate, financing_rate, financing_spread,
    borrow_bps, short_rebate_rate, spread_bps and borrow_available by a dated table.
    """
    schedules = schedules or {}
    w = k.over_time()
    if "ann" not in bars.columns:
        bars = bars.withColumn("ann", annualization(F.col("ticker")))
    price = F.col(opts.price)
    ret = F.coalesce(price / F.lag(price).over(w) - 1, F.lit(0.0))
    rates = {"cash_rate": "m_cash", "financing_rate": "_fin", "financing_spread": "_fin_spread",
             "borrow_bps": "_borrow", "short_rebate_rate": "m_rebate"}
    volume = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in bars.columns else F.lit(0.0)
    out = bars.withColumns({"m_ret": ret, "m_price": price, "m_volume": volume})
    out = out.withColumns({c: constant_accrual(getattr(opts, r), w) for r, c in rates.items() if r not in schedules})
    for r, c in rates.items():
        if r in schedules:
            out = accrual(out, schedules[r], c)
    if "spread_bps" in schedules:
        out = as_of(out, schedules["spread_bps"], "m_spread")
    else:
        out = out.withColumn("m_spread", F.lit(float(opts.spread_bps)))
    if "borrow_available" in schedules:
        out = as_of(out, schedules["borrow_available"], "m_ok")
    elif "m_ok" not in out.columns:
        out = out.withColumn("m_ok", F.lit(True))
    scale = F.lit(1.0) if opts.vol_target is None else k.vol_scale("m_ret", opts.vol_lookback, opts.vol_target, "ann", w)
    return out.withColumns({
        "m_fin": F.col("_fin") + F.col("_fin_spread"),
        "m_borrow": F.col("_borrow") / 10000.0,
        "m_ok_prev": F.coalesce(F.lag("m_ok").over(w), F.lit(True)),
        "m_scale": scale,
    }).drop("_fin", "_fin_spread", "_borrow")


def align_positions(bars: DataFrame, positions: DataFrame, keys=("ticker",)) -> DataFrame:
    """Caller-supplied targets on the bars' dates: forward filled, 0 before the first one."""
    joined = bars.join(positions.select(*keys, "date", "target"), [*keys, "date"], "left")
    return joined.withColumn("target", F.coalesce(k.forward_fill("target", k.over_time(keys)), F.lit(0.0)))


def constant_market(opts: LedgerOptions, schedules=()) -> dict[str, float | bool]:
    """Market columns that are the same on every bar; wide scans need not carry them."""
    fixed = {}
    if not {"cash_rate"} & set(schedules) and opts.cash_rate == 0:
        fixed["m_cash"] = 0.0
    if not {"financing_rate", "financing_spread"} & set(schedules) and opts.financing_rate == opts.financing_spread == 0:
        fixed["m_fin"] = 0.0
    if "borrow_bps" not in schedules and opts.borrow_bps == 0:
        fixed["m_borrow"] = 0.0
    if "short_rebate_rate" not in schedules and opts.short_rebate_rate == 0:
        fixed["m_rebate"] = 0.0
    if "spread_bps" not in schedules:
        fixed["m_spread"] = float(opts.spread_bps)
    if "borrow_available" not in schedules:
        fixed.update(m_ok=True, m_ok_prev=True)
    if opts.vol_target is None:
        fixed["m_scale"] = 1.0
    return fixed


def proportional_ledger(df: DataFrame, opts: LedgerOptions, keys=("ticker",), order=("date",), keep_log: bool = False) -> DataFrame:
    """Window form. ``df`` has a complete ``target`` and the market columns.

    A market column that is absent takes its constant from ``opts``. With
    ``keep_log`` the running log of the account is kept as ``log_equity`` (NULL once it is ruined).
    """
    fixed = constant_market(opts)
    m = {c: F.col(c) if c in df.columns else F.lit(fixed[c]) for c in ("m_ret", "m_cash", "m_fin", "m_borrow", "m_rebate", "m_spread",
                                                                       "m_ok", "m_ok_prev", "m_scale") if c in df.columns or c in fixed}
    if not opts.proportional:
        raise ValueError("min fee, impact and participation limits need the sequential ledger")
    w = Window.partitionBy(*keys).orderBy(*order)
    lev = float(opts.max_leverage)
    lag = int(opts.execution_lag)
    df = df.withColumn("_t", k.clip(F.col("target") * m["m_scale"], -lev, lev))
    now = F.coalesce(k.shifted("_t", lag, w), F.lit(0.0))
    last = F.coalesce(F.lag("_t", lag + 1).over(w), F.lit(0.0))
    df = df.withColumns({"_want": now, "_held": last})
    blocked = (F.col("_want") < 0) & ~m["m_ok"]
    df = df.withColumns({
        "_blocked": blocked,
        "_d": F.when(blocked, 0.0).otherwise(F.col("_want")),
        "_h": F.when((F.col("_held") < 0) & ~m["m_ok_prev"], 0.0).otherwise(F.col("_held")),
    })
    h, d, r = F.col("_h"), F.col("_d"), m["m_ret"]
    short = F.greatest(-h, F.lit(0.0))
    pre = (
        h * r
        + F.greatest(1.0 - F.greatest(h, F.lit(0.0)), F.lit(0.0)) * m["m_cash"]
        + short * m["m_rebate"]
        - F.greatest(F.abs(h) - 1.0, F.lit(0.0)) * m["m_fin"]
        - short * m["m_borrow"]
    )
    rate = (F.lit(opts.cost_bps + opts.slippage_bps) + m["m_spread"] / 2.0) / 10000.0
    df = df.withColumns({"_pre": pre, "_k": rate})
    alive = F.col("_pre") > -1
    gap = F.when(alive, d - h * (1 + r) / (1 + F.col("_pre")))
    df = df.withColumn("_gap", gap)
    fill = F.when(F.abs(F.col("_gap")) <= NO_TRADE, 0.0).otherwise(
        F.abs(F.col("_gap")) / (1 + d * F.col("_k") * F.signum(F.col("_gap")))
    )
    df = df.withColumn("_q", F.when(alive, F.abs(fill)).otherwise(0.0))
    cost = F.col("_k") * F.col("_q") * (1 + F.col("_pre"))
    df = df.withColumns({"_c": F.when(alive, cost).otherwise(0.0)})
    df = df.withColumn("_raw", F.when(alive, F.greatest(F.col("_pre") - F.col("_c"), F.lit(-1.0))).otherwise(-1.0))
    ruined = F.max((F.col("_raw") <= -1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    logs = F.sum(F.when(F.col("_raw") > -1, F.log1p("_raw"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_gone": F.coalesce(ruined, F.lit(0)) == 1, "_logs": F.coalesce(logs, F.lit(0.0))})
    gone, dies = F.col("_gone"), F.col("_raw") <= -1

    def live(x):
        return F.when(gone, 0.0).otherwise(x)

    out = df.withColumns({
        "ret": live(F.col("_raw")),
        "equity": F.when(gone | dies, 0.0).otherwise(F.exp("_logs")),
        "trade": live(F.col("_q")),
        "requested_trade": live(F.col("_q")),
        "position": F.when(gone | dies, 0.0).otherwise(d),
        "held": live(h),
        "txn_cost": live(F.col("_c")),
        "participation": F.lit(0.0),
        "capacity_constrained": F.lit(False),
        "borrow_blocked": F.coalesce(F.col("_blocked") & ~gone & alive, F.lit(False)),
    })
    out = out.withColumn("log_equity", F.when(~gone, F.col("_logs"))) if keep_log else out
    return out.drop("_t", "_want", "_held", "_blocked", "_d", "_h", "_pre", "_k", "_gap", "_q", "_c", "_raw", "_gone", "_logs")


LEDGER_FIELDS = ("ret", "equity", "trade", "requested_trade", "position", "held", "txn_cost", "participation",
                 "capacity_constrained", "borrow_blocked")
_FLOATS = LEDGER_FIELDS[:8]


_ACCOUNT = ("m_ret", "m_cash", "m_fin", "m_borrow", "m_rebate", "m_spread", "m_ok", "m_price", "m_volume")


def sequential_ledger(df: DataFrame, opts: LedgerOptions, keys=("ticker",), candidates=(), order="date") -> DataFrame:
    """Path-dependent form: minimum fee, nonlinear impact, participation cap, partial fills.

    The calendar of one candidate (``keys`` and ``candidates``) is the unit of work; a task advances some hundreds of them
    together. A target that the costs put out of reach leaves NaN from there on instead of ending the job.
    """
    lev, lag = float(opts.max_leverage), int(opts.execution_lag)
    ids = [*keys, *candidates]
    w = Window.partitionBy(*ids).orderBy(order)
    df = df.withColumn("_t", k.clip(F.col("target") * F.col("m_scale"), -lev, lev))
    df = df.withColumn("_want", F.coalesce(k.shifted("_t", lag, w), F.lit(0.0))).drop("_t")

    def rule(bars, _):
        return run_account(bars["_want"], {c: bars[c] for c in _ACCOUNT}, opts)

    out = {**dict.fromkeys(_FLOATS, "double"), **dict.fromkeys(LEDGER_FIELDS[8:], "boolean")}
    return over_bars(df, ids, (order,), ("_want", *_ACCOUNT), (), rule, out).drop("_want")


def ledger(df: DataFrame, opts: LedgerOptions, keys=("ticker",), candidates=(), order="date") -> DataFrame:
    """Pick the window form whenever the cost model allows it."""
    if opts.proportional:
        return proportional_ledger(df, opts, (*keys, *candidates), (order,))
    return sequential_ledger(df, opts, keys, candidates, order)


def buy_and_hold(market: DataFrame) -> DataFrame:
    return market.withColumn("target", F.lit(1.0))


def cash_only(market: DataFrame) -> DataFrame:
    return market.withColumn("target", F.lit(0.0))


def against_benchmark(targets: DataFrame, opts: LedgerOptions, keys=("ticker",)) -> DataFrame:
    """Ledgers of the supplied targets and of buy-and-hold on the same bars, tagged by ``account``."""
    both = targets.withColumn("account", F.explode(F.array(F.lit("selected"), F.lit("benchmark"))))
    both = both.withColumn("target", F.when(F.col("account") == "benchmark", 1.0).otherwise(F.col("target")))
    return ledger(both, opts, keys, ("account",))


def with_options(opts: LedgerOptions, **changes) -> LedgerOptions:
    return replace(opts, **changes)
