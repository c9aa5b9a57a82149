"""Ledgers, metrics and comparisons of ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from ..operators.ledger import LedgerOptions, against_benchmark, ledger, with_market
from ..operators.metrics import case_totals, evaluate, period_metrics
from ..operators.search import ledger_of, positions
from ..operators.splits import with_folds, with_periods
from . import views as v
from .registry import ctes, ewm, full, lag, over, query, r, ret, rounded
from .rules import sig
from .sqlparts import CUM, RETURN_COLS, ledger_sql, metrics_sql, periods_sql

COLS = ("ret", "equity", "trade", "position", "held", "txn_cost", "borrow_blocked")
METRICS = RETURN_COLS.replace(" ", "").split(",")


def led_out(src="led", extra="") -> str:
    return (f"select ticker, date{extra}, {r('ret')} as ret, {r('equity', 5)} as equity, {r('trade')} as trade, {r('position')} as position, {r('held')} as held, "
            f"{r('txn_cost')} as txn_cost, borrow_blocked from {src}")


def led_select(df, *extra):
    return rounded(df.select("ticker", "date", *extra, *COLS), 6, equity=5)


TS = sig(ret("close", 12, 1), "0.002")
REAL = LedgerOptions(cost_bps=1, slippage_bps=0.5, spread_bps=8, execution_lag=1, max_leverage=1.5, cash_rate=0.02, financing_rate=0.04,
                     financing_spread=0.01, borrow_bps=150, short_rebate_rate=0.005)
REAL_SQL = dict(lag=1, k="0.00055", lev=1.5, cash=0.02, fin=0.05, borrow=150.0, rebate=0.005)


def _tsmom(bars, size=1.8):
    return positions(bars, "tsmom", lookback=12, threshold=0.002, skip_recent=1, position_size=size)


def _tsmom_ledger(bars, opts, size=1.8):
    return ledger_of(bars, "tsmom", opts, lookback=12, threshold=0.002, skip_recent=1, position_size=size)


@query("led_proportional", ctes(v.SQL_VWAP, f"s as (select *, 1.8*{TS} as target from vwap)", ledger_sql("s", **REAL_SQL)) + led_out())
def _(t):
    b = v.vwap_bars(t)
    return led_select(_tsmom_ledger(b, REAL))


@query("led_ruin", ctes(v.SQL_BARS, f"s as (select *, 1.8*{TS} as target from bars)", ledger_sql("s", lag=0, k="0.0001")) + led_out())
def _(t):
    b, o = v.order_bars(t), LedgerOptions()
    return led_select(_tsmom_ledger(b, o))


@query("led_vol_target", ctes(v.SQL_WEEKLY, f"s0 as (select *, {TS} as target, coalesce({ret('close', 1)},0) as r1 from weekly)", f"s as (select *, coalesce(0.5/({full('stddev_samp', 'r1', 10)}*sqrt(252.0)+1e-10),0) as sc from s0)",
       ledger_sql("s", lag=2, k="0.0001", scale="sc")) + led_out())
def _(t):
    b, o = v.weekly_bars(t), LedgerOptions(vol_target=0.5, vol_lookback=10, execution_lag=2)
    return led_select(_tsmom_ledger(b, o, 1.0))


@query("led_next_open", ctes(v.SQL_VWAP, f"s as (select *, {TS} as target from vwap)", ledger_sql("s", lag=1, k="0.0001", price="open")) + led_out())
def _(t):
    b, o = v.vwap_bars(t), LedgerOptions(execution_lag=1, price="open")
    return led_select(_tsmom_ledger(b, o, 1.0))


@query("led_schedules", ctes(v.SQL_VWAP, v.SQL_RATES, "iv as (select effective_at as a, coalesce(lead(effective_at) over (order by effective_at), timestamp '2100-01-01') as b, value from rates)",
       f"p as (select ticker,date,{lag('date')} as prev from vwap)",
       "ac as (select p.ticker, p.date, coalesce(sum(iv.value*epoch(least(iv.b,cast(p.date as timestamp))-greatest(iv.a,cast(p.prev as timestamp)))/31557600.0),0) as acc from p left join iv on iv.a<p.date and iv.b>p.prev group by 1,2)",
       "av as (select vwap.ticker, vwap.date, rates.value<0.05 as avail, rates.value*100 as spr from vwap asof join rates on vwap.date>=rates.effective_at)",
       f"s as (select vwap.*, acc, avail, spr, {TS} as target from vwap join ac using (ticker,date) join av using (ticker,date))",
       ledger_sql("s", lag=1, k="(1e-4+spr/20000.0)", ok="avail", cash_col="acc")) + led_out())
def _(t):
    b, rates = v.vwap_bars(t), v.rates(t)
    o = LedgerOptions(execution_lag=1)
    market = with_market(b, o, {
        "cash_rate": rates, "borrow_available": rates.select("effective_at", (F.col("value") < 0.05).alias("value")),
        "spread_bps": rates.select("effective_at", (F.col("value") * 100).alias("value"))})
    return led_select(ledger(market.join(_tsmom(b, 1.0), ["ticker", "date"]), o))


@query("led_against_benchmark", ctes(v.SQL_VWAP, f"s as (select *, 'selected' as account, {TS} as target from vwap union all select *, 'benchmark', 1e0 from vwap)", ledger_sql("s", keys="ticker,account", **REAL_SQL)) + led_out(extra=", account"))
def _(t):
    b = v.vwap_bars(t)
    return led_select(against_benchmark(with_market(b, REAL).join(_tsmom(b, 1.0), ["ticker", "date"]), REAL), "account")


# --- minimum fee, participation cap: the sequential account -----------------------------------------------------------

FULL = LedgerOptions(cost_bps=5, slippage_bps=1, spread_bps=4, execution_lag=1, min_fee=25.0, max_participation=0.2, initial_capital=1e6, cash_rate=0.02, borrow_bps=100)
_D = "(case when s.d is null then 0 else s.d end)"
SQL_FULL = (
    f"s as materialized (select *, {TS} as target, row_number() {over()}-1 as rn, coalesce({ret('close', 1)},0) as rr, coalesce(date_diff('day',{lag('date')},date)/365.25,0) as dt, close*volume as dv from weekly)",
    f"s1 as materialized (select *, coalesce({lag('target')},0) as d from s)",
    """acct as (
 select ticker, date, rn, 1e6 as nav, 0e0 as asset, 0e0 as ret, 0e0 as trade, 0e0 as requested, 0e0 as cost, 0e0 as part, false as capped, true as alive from s1 where rn=0
 union all
 select ticker, date, rn, case when alive and res>-1 then nav*(1+res) else 0e0 end, case when alive and res>-1 then marked+side*filled else 0e0 end,
  case when not palive then 0e0 when not alive then -1e0 else res end, case when alive then filled/pnav else 0e0 end, case when alive then x/pnav else 0e0 end, case when alive then paid/nav else 0e0 end,
  case when alive then part else 0e0 end, alive and x>0 and filled+1e-12<x, alive and res>-1
 from (select *, case when alive then greatest(pre-paid/nav,-1) else -1 end as res from
 (select *, case when filled>0 or tiny then greatest(filled*5e-4,25.0)+filled*3e-4 else 0e0 end as paid, case when dv>0 then filled/dv else 0 end as part from
 (select *, least(x, greatest(dv*0.2,0)) as filled from
 (select *, case when d=0 then abs(marked) when not need or not better then 0e0 else x0 end as x, case when d=0 then -sign(marked) else side0 end as side, (need and better and x0=0 and d<>0) as tiny from
 (select *, (pnav-cost0)>0 and abs((marked+side0*x0)/(pnav-cost0)-d)<abs(marked/pnav-d) as better from
 (select *, greatest(x0*5e-4,25.0)+x0*3e-4 as cost0 from
 (select *, case when not need then 0e0 when sign(init+d*25.0)<>sign(init) then 0e0
   when 5e-4*(-(init+d*25.0)/(side0+d*3e-4))<=25.0 then -(init+d*25.0)/(side0+d*3e-4) else -init/(side0+d*8e-4) end as x0 from
 (select *, marked-d*pnav as init, case when marked-d*pnav>0 then -1 else 1 end as side0, abs(marked-d*pnav)>1e-14*greatest(pnav,1) and d<>0 as need from
 (select s.ticker, s.date, s.rn, s.dv, s.d, e.alive as palive, (e.alive and pre_.v>-1) as alive, case when e.alive then e.nav else 1e0 end as nav, pre_.v as pre,
   (case when e.alive then e.nav else 1e0 end)*(1+pre_.v) as pnav, e.asset*(1+s.rr) as marked
  from acct e join s1 s on s.ticker=e.ticker and s.rn=e.rn+1,
  lateral (select h*s.rr+greatest(1-greatest(h,0),0)*0.02*s.dt-greatest(-h,0)*0.01*s.dt as v from (select case when e.alive then e.asset/e.nav else 0e0 end as h)) pre_
 ))))))))))""")


@query("led_min_fee_and_capacity", ctes(v.SQL_WEEKLY, *SQL_FULL, recursive=True)
       + f"select ticker, date, {r('ret')} as ret, {r('trade')} as trade, {r('requested')} as requested_trade, {r('cost')} as txn_cost, {r('part')} as participation, capped as capacity_constrained from acct")
def _(t):
    b = v.weekly_bars(t)
    led = _tsmom_ledger(b, FULL, 1.0)
    return rounded(led.select("ticker", "date", "ret", "trade", "requested_trade", "txn_cost", "participation", "capacity_constrained"))


@query("led_impact")
def _(t):
    """Square-root impact has no closed form in SQL; the walk is tested against a scalar account."""
    b = v.weekly_bars(t)
    o = LedgerOptions(cost_bps=2, impact_bps=12, impact_exponent=0.5, max_participation=0.3, min_fee=1, execution_lag=1, initial_capital=2e6)
    return rounded(_tsmom_ledger(b, o).select(
        "ticker", "date", "ret", "equity", "trade", "requested_trade", "position", "txn_cost", "participation", "capacity_constrained"))


# --- metrics ----------------------------------------------------------------------------------------------------------

@query("agg_evaluate", ctes(v.SQL_WEEKLY, f"s as (select ticker, date, coalesce({ret('close', 1)},0)*0.5 as ret from weekly)", metrics_sql("s", rf=0.03, activity=False)) + f"select ticker, sharpe0 as sharpe, {RETURN_COLS}, n_observations from met")
def _(t):
    from ..functions import kernels as k
    b = v.weekly_bars(t)
    x = b.select("ticker", "date", "ann", (F.coalesce(k.simple_return("close", 1, k.over_time()), F.lit(0.0)) * 0.5).alias("ret"))
    return evaluate(x, ("ticker",), 0.03)


@query("agg_evaluate_ruin", ctes(v.SQL_BARS, f"s0 as (select ticker, date, coalesce({ret('close', 1)},0)*-0.8 as r0 from bars)",
       f"s as (select ticker, date, case when coalesce(min(r0) {over(frame='rows between unbounded preceding and 1 preceding')},0)<=-1 then 0 else greatest(r0,-1) end as ret from s0)", metrics_sql("s", activity=False)) + f"select ticker, sharpe0 as sharpe, {RETURN_COLS}, n_observations from met")
def _(t):
    from ..functions import kernels as k
    b = v.order_bars(t).withColumn("ann", F.lit(252.0))
    return evaluate(b.select("ticker", "date", "ann", (F.coalesce(k.simple_return("close", 1, k.over_time()), F.lit(0.0)) * -0.8).alias("ret")), ("ticker",))


_FOLD = ", ".join(f"max(case when fold={i} then s end) as fold{i}" for i in range(1, 5))


@query("agg_period_metrics", ctes(v.SQL_VWAP, f"s as (select *, 1.8*{TS} as target from vwap)", ledger_sql("s", **REAL_SQL), periods_sql("led", folds=4), metrics_sql("per", keys="ticker,period"),
       "fs as (select ticker, fold, case when count(*)<2 or stddev_samp(ret)<1e-10 or avg(abs(held))<=1e-12 then -99.0 else round_even(avg(ret)*252.0/(stddev_samp(ret)*sqrt(252.0)+1e-10),4)+0.0 end as s from per where fold is not null group by 1,2)",
       f"fw as (select ticker, 'val' as period, {_FOLD} from fs group by 1)")
       + f"""select ticker, period, case when undefined_ then -99.0 else sharpe0 end as sharpe, {RETURN_COLS}, n_observations, trade_count, {r('exposure')} as exposure, {r('turnover', 4)} as turnover,
 {r('transaction_cost_drag')} as transaction_cost_drag, fold1, fold2, fold3, fold4 from met left join fw using (ticker, period)""")
def _(t):
    b = v.vwap_bars(t)
    led = _tsmom_ledger(b, REAL)
    m = period_metrics(with_folds(with_periods(led), 4), ("ticker", "period"), folds=4)
    folds = [F.get("fold_sharpes", F.lit(i)).alias(f"fold{i + 1}") for i in range(4)]
    return rounded(m.select("ticker", "period", "sharpe", *METRICS, "n_observations", "trade_count", "exposure", "turnover", "transaction_cost_drag", *folds), 6, turnover=4)


_sm = ewm("sm", "ts0", [("target", 2.0 / 3.0, "st")])
SUITE = (
    f"ts0 as materialized (select *, row_number() {over()}-1 as rn, {sig(ret('close', 12, 1), '0.002')} as target from weekly)", _sm,
    f"""suite as materialized (select *, 'cash' as case_id, 0e0 as target from weekly union all select *, 'buy_and_hold', 1e0 from weekly
 union all select *, 'ma_cross', case when {full('avg', 'close', 5)}>{full('avg', 'close', 20)} then 1e0 else 0e0 end from weekly
 union all select ts0.* exclude (rn,target), 'tsmom', st*1.8 from ts0 join sm using (ticker,rn))""")


def suite_ledgers(t, opts):
    """Fixed rules x assets in one ledger pass."""
    b = v.weekly_bars(t)
    rules = [("cash", positions(b, "tsmom", position_size=0.0)), ("buy_and_hold", b.select("ticker", "date", F.lit(1.0).alias("target"))),
             ("ma_cross", positions(b, "ma_cross", fast=5, slow=20, long_short=False)),
             ("tsmom", positions(b, "tsmom", lookback=12, threshold=0.002, skip_recent=1, signal_smooth=2, position_size=1.8))]
    targets = None
    for name, p in rules:
        part = p.withColumn("case_id", F.lit(name))
        targets = part if targets is None else targets.unionByName(part)
    return ledger(with_market(b, opts).join(targets, ["ticker", "date"]), opts, ("ticker",), ("case_id",))


@query("led_suite_totals", ctes(v.SQL_WEEKLY, *SUITE, ledger_sql("suite", keys="ticker,case_id", **REAL_SQL), recursive=True)
       + f"""select ticker, case_id, {r('arg_max(equity,date)')} as final_equity, {r('sum(trade)')} as turnover, {r('sum(trade)')} as requested_turnover, {r('sum(txn_cost)')} as transaction_cost_drag,
 count(*) filter (where trade>1e-12) as trade_count, cast(0 as bigint) as capacity_constrained_bars, count(*) filter (where borrow_blocked) as borrow_blocked_bars from led group by 1,2""")
def _(t):
    return rounded(case_totals(suite_ledgers(t, REAL), ("ticker", "case_id")))


@query("agg_snapshot_diff", ctes(v.SQL_WEEKLY, *SUITE, ledger_sql("suite", keys="ticker,case_id", **REAL_SQL), ledger_sql("suite", name="alt", keys="ticker,case_id", **{**REAL_SQL, "k": "0.00155", "lev": 1.2}),
       "j as (select a.ticker, a.case_id, a.date, a.ret as r0, b.ret as r1, a.equity as e0, b.equity as e1, a.trade as t0, b.trade as t1 from led a join alt b using (ticker,case_id,date))",
       "o as (select *, row_number() over (partition by ticker,case_id order by date)-1 as bar from j)",
       "u as (select ticker,case_id,bar,'ret' as field,r0 as x,r1 as y from o union all select ticker,case_id,bar,'equity',e0,e1 from o union all select ticker,case_id,bar,'trade',t0,t1 from o)",
       "f as (select *, not (abs(x-y)<=1e-11+1e-9*abs(y)) as ch from u)", recursive=True)
       + f"select ticker, case_id, field, count(*) filter (where ch) as changed_bars, min(bar) filter (where ch) as first_bar, {r('max(abs(x-y))')} as max_abs_delta from f group by 1,2,3")
def _(t):
    from dataclasses import replace
    a, b = suite_ledgers(t, REAL), suite_ledgers(t, replace(REAL, cost_bps=11, max_leverage=1.2))
    return rounded(compare.diff(compare.bars_of(a, ("ticker", "case_id")), compare.bars_of(b, ("ticker", "case_id")), ("ticker", "case_id"), ("ret", "equity", "trade")))


def _two_suites(t):
    from dataclasses import replace
    return suite_ledgers(t, REAL), suite_ledgers(t, replace(REAL, cost_bps=11, max_leverage=1.2))


_TWO = (v.SQL_WEEKLY, *SUITE, ledger_sql("suite", keys="ticker,case_id", **REAL_SQL),
        ledger_sql("suite", name="alt", keys="ticker,case_id", **{**REAL_SQL, "k": "0.00155", "lev": 1.2}))


@query("agg_metric_deltas", ctes(*_TWO, "ma as (select ticker,case_id,max_by(equity,date) as final_equity,sum(trade) as turnover from led group by 1,2)",
       "mb as (select ticker,case_id,max_by(equity,date) as final_equity,sum(trade) as turnover from alt group by 1,2)",
       "u as (select a.ticker,a.case_id,'final_equity' as metric,a.final_equity as x,b.final_equity as y from ma a join mb b using (ticker,case_id) union all select a.ticker,a.case_id,'turnover',a.turnover,b.turnover from ma a join mb b using (ticker,case_id))", recursive=True)
       + f"select ticker, case_id, metric, {r('x')} as actual, {r('y')} as expected, {r('x-y')} as delta, not coalesce(abs(x-y)<=greatest(1e-11,1e-9*greatest(abs(x),abs(y))),false) as changed from u")
def _(t):
    a, b = (led.groupBy("ticker", "case_id").agg(F.max_by("equity", "date").alias("final_equity"), F.sum("trade").alias("turnover")) for led in _two_suites(t))
    return rounded(compare.metric_deltas(a, b, ("ticker", "case_id"), ("final_equity", "turnover")))


@query("agg_case_status", ctes(*_TWO, "j as (select a.ticker, a.case_id, not (abs(a.ret-b.ret)<=1e-11+1e-9*abs(b.ret)) as ch from led a join alt b using (ticker,case_id,date))", recursive=True)
       + "select ticker, case_id, case when bool_or(ch) then 'changed' else 'passed' end as status from j group by 1,2")
def _(t):
    keys = ("ticker", "case_id")
    a, b = (compare.bars_of(led, keys) for led in _two_suites(t))
    return compare.case_status(compare.diff(a, b, keys, ("ret",)), keys)
