"""SQL twins of the larger operators: ledger, metrics, splits and moments, as CTE text."""

from __future__ import annotations

from .registry import r

FIRST = "rows between unbounded preceding and 1 preceding"
CUM = "rows between unbounded preceding and current row"


def ledger_sql(src: str, name: str = "led", keys: str = "ticker", lag: int = 0, k: str = "0.0001", lev: float = 2.0,
               cash: float = 0.0, fin: float = 0.0, borrow: float = 0.0, rebate: float = 0.0, price: str = "close",
               ok: str = "true", scale: str = "1.0", cash_col: str | None = None) -> str:
    """``src`` has keys, date, target, the price column and whatever ``ok``/``scale``/``k`` mention."""
    w = f"partition by {keys} order by date"
    d = "t" if lag == 0 else f"coalesce(lag(t,{lag}) over ({w}),0)"
    cash_expr = cash_col or f"{cash}*dt"
    return f"""{name}_a as materialized (select *, {ok} as ok_, {k} as k_, coalesce({price}/lag({price}) over ({w})-1,0) as r_,
 coalesce(date_diff('day',lag(date) over ({w}),date)/365.25,0) as dt, greatest(least(target*({scale}),{lev}),-{lev}) as t from {src}),
{name}_b as (select *, {d} as want, coalesce(lag(t,{lag + 1}) over ({w}),0) as hraw, coalesce(lag(ok_) over ({w}),true) as okp from {name}_a),
{name}_c as (select *, case when want<0 and not ok_ then 0 else want end as d_, case when hraw<0 and not okp then 0 else hraw end as h_ from {name}_b),
{name}_d as (select *, h_*r_+greatest(1-greatest(h_,0),0)*({cash_expr})+greatest(-h_,0)*{rebate}*dt
 -greatest(abs(h_)-1,0)*{fin}*dt-greatest(-h_,0)*{borrow}/10000.0*dt as pre from {name}_c),
{name}_e as (select *, case when pre>-1 then d_-h_*(1+r_)/(1+pre) end as gap from {name}_d),
{name}_f as (select *, case when pre>-1 then (case when abs(gap)<=1e-14 then 0 else abs(gap)/(1+d_*k_*sign(gap)) end) else 0 end as q from {name}_e),
{name}_g as (select *, case when pre>-1 then greatest(pre-k_*q*(1+pre),-1) else -1 end as raw from {name}_f),
{name}_h as materialized (select *, coalesce(max(case when raw<=-1 then 1 else 0 end) over ({w} {FIRST}),0)=1 as gone from {name}_g),
{name}_i as (select *, case when gone then 0 else raw end as ret, case when gone then 0 else q end as trade,
 case when gone or raw<=-1 then 0 else d_ end as position, case when gone then 0 else h_ end as held,
 case when gone or pre<=-1 then 0 else k_*q*(1+pre) end as txn_cost, (want<0 and not ok_ and not gone and pre>-1) as borrow_blocked from {name}_h),
{name} as materialized (select *, greatest(product(1+ret) over ({w} {CUM}),0) as equity from {name}_i)"""


def metrics_sql(src: str, name: str = "met", keys: str = "ticker", rf: float = 0.0, ann: str = "252.0", activity: bool = True) -> str:
    """``src`` has keys, date, ret (and the activity columns)."""
    w = f"partition by {keys} order by date"
    act = """, count(*) filter (where trade>1e-12) as trade_count, avg(abs(held)) as exposure, sum(trade) as turnover,
 sum(trade) as requested_turnover, sum(txn_cost) as transaction_cost_drag""" if activity else ""
    und = " or exposure<=1e-12" if activity else ""
    return f"""{name}_a as materialized (select *, greatest(product(1+ret) over ({w} {CUM}),0) as eq_ from {src}),
{name}_b as (select *, eq_/greatest(max(eq_) over ({w} {CUM}),1)-1 as dd_ from {name}_a),
{name}_c as materialized (select {keys}, count(*) as n_observations, avg(ret) as mean_, coalesce(stddev_samp(ret),0) as std_,
 sqrt(avg(pow(least(ret-{rf}/{ann},0),2))) as down_, min(dd_) as mdd_, arg_max(eq_,date) as last_, min(eq_) as low_,
 avg(case when ret>0 then 1.0 else 0.0 end) as win_, coalesce(sum(ret) filter (where ret>0),0) as gain_,
 coalesce(sum(-ret) filter (where ret<0),0) as loss_, skewness(ret) as sk_, kurtosis(ret) as ku_{act} from {name}_b group by {keys}),
{name}_d as (select *, case when low_>0 then pow(last_,{ann}/n_observations)-1 else -1 end as cagr_ from {name}_c),
{name} as (select *, {_re(f"case when std_<1e-10 then 0 else (mean_*{ann}-{rf})/(std_*sqrt({ann})+1e-10) end")} as sharpe0,
 {_re(f"case when down_<1e-10 then 0 else (mean_*{ann}-{rf})/(down_*sqrt({ann})) end")} as sortino,
 {_re("cagr_/(abs(mdd_)+1e-10)")} as calmar, {_re("mdd_")} as max_drawdown, {_re("cagr_")} as cagr, {_re("last_-1")} as total_return,
 {_re(f"std_*sqrt({ann})")} as volatility, {_re("win_")} as win_rate, {_re("gain_/(loss_+1e-10)")} as profit_factor,
 {_re("case when n_observations<3 or std_<1e-10 then 0 else sk_ end")} as skew,
 {_re("case when n_observations<4 or std_<1e-10 then 0 else ku_ end")} as kurtosis,
 case when n_observations<2 or std_<1e-10{und} then true else false end as undefined_ from {name}_d)"""


def _re(x: str) -> str:
    return f"(round_even({x},4)+0.0)"


RETURN_COLS = ("sortino, calmar, max_drawdown, cagr, total_return, volatility, win_rate, profit_factor, skew, kurtosis")


def periods_sql(src: str, name: str = "per", folds: int | None = None) -> str:
    """Adds rn (from 0), n, period and optionally fold."""
    fold = (f", case when period='val' then ntile({folds}) over (partition by ticker,period order by date) end as fold" if folds else "")
    return f"""{name}_a as (select *, row_number() over (partition by ticker order by date)-1 as rn_, count(*) over (partition by ticker) as n_ from {src}),
{name}_b as (select *, greatest(1,least(floor(n_*0.4),n_-2)) as s1_ from {name}_a),
{name}_c as (select *, greatest(s1_+1,least(floor(n_*0.8),n_-1)) as s2_ from {name}_b),
{name}_d as (select *, case when n_<3 then null when rn_<s1_ then 'train' when rn_<s2_ then 'val' else 'test' end as period from {name}_c),
{name} as materialized (select *{fold} from {name}_d)"""
