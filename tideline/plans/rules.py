"""Target weights of every rule-based strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators.search import positions
from . import views as v
from .registry import ctes, ewm, full, lag, over, query, r, ret, rounded, trail
from .technical import HEIKIN, SQL_TR, adx_sql, ranked, rsi_sql

W = v.SQL_WEEKLY
V = v.SQL_VWAP


def sig(score: str, thr: str = "0", shorts: bool = True) -> str:
    down = f"when {score}<-({thr}) then -1e0 " if shorts else ""
    return f"(case {down}when {score}>{thr} then 1e0 else 0e0 end)"


def out(expr: str, src: str) -> str:
    return f"select ticker, date, {r(expr)} as target from {src}"


def smooth(src: str, span: int, size: float = 1.0) -> tuple[str, str]:
    """CTE and final select that smooth ``target`` of ``src`` (columns ticker, date, rn, target)."""
    cte = ewm("sm", src, [("target", k.span_alpha(span), "st")])
    return cte, f"select x.ticker, x.date, {r(f'sm.st*{size}')} as target from {src} x join sm using (ticker,rn)"


def rule(name: str, sql: str, strategy: str, bars, **params):
    @query(name, sql)
    def _(t):
        return rounded(positions(bars(t), strategy, **params))


rule("str_tsmom", ctes(V) + out(sig(ret("close", 21, 2), "0.01"), "vwap"), "tsmom", v.vwap_bars, lookback=21, threshold=0.01, skip_recent=2)
_cte, _sel = smooth("tt", 5, 1.5)
rule("str_tsmom_smoothed", ctes(W, f"tt as materialized (select ticker,date,row_number() {over()}-1 as rn,{sig(ret('close', 10), '0.002', False)} as target from weekly)", _cte, recursive=True) + _sel,
     "tsmom", v.weekly_bars, lookback=10, threshold=0.002, long_short=False, signal_smooth=5, position_size=1.5)
rule("str_ma_cross", ctes(V) + out(sig(f"({full('avg', 'close', 10)}-{full('avg', 'close', 50)})"), "vwap"), "ma_cross", v.vwap_bars)
rule("str_ma_cross_dema", ctes(W, ranked("weekly"), ewm("e", "src", [("close", k.span_alpha(5), "a"), ("close", k.span_alpha(20), "b")]), "e1 as materialized (select * from e)",
     ewm("f", "e1", [("a", k.span_alpha(5), "aa"), ("b", k.span_alpha(20), "bb")]), recursive=True)
     + f"select s.ticker, s.date, {r(sig('((2*e.a-f.aa)-(2*e.b-f.bb))'))} as target from src s join e using (ticker,rn) join f using (ticker,rn)",
     "ma_cross", v.weekly_bars, fast=5, slow=20, ma_type="dema")
for _mode, _shorts, _up, _down in (
    ("crossover", True, "d>0", "d<0"), ("histogram", False, "h>0", "h<0"), ("zero_filter", True, "d>0 and line>0", "d<0 and line<0")):
    rule(f"str_macd_{_mode}", ctes(W, ranked("weekly"), ewm("e", "src", [("close", k.span_alpha(8), "a"), ("close", k.span_alpha(21), "b")]), "m as materialized (select *, a-b as line from e)",
         ewm("g", "m", [("line", k.span_alpha(5), "sg")]), f"j as (select src.ticker, src.date, line, line-sg as d, (line-sg)-lag(line-sg) {over(order='src.date', keys='src.ticker')} as h from src join m using (ticker,rn) join g using (ticker,rn))", recursive=True)
         + out(f"(case {'when ' + _down + ' then -1e0' if _shorts else ''} when {_up} then 1e0 else 0e0 end)", "j"),
         "macd", v.weekly_bars, fast=8, slow=21, signal=5, long_short=_shorts, mode=_mode)
_RSI = f"x as (select *, close-{lag('close')} as dlt from {{}})"
rule("str_rsi_momentum", ctes(V, _RSI.format("vwap"), f"y as (select *, {rsi_sql(14)} as q from x)") + out("(case when q<40 then -1e0 when q>55 then 1e0 else 0e0 end)", "y"),
     "rsi", v.vwap_bars, buy_threshold=55, sell_threshold=40)
rule("str_rsi_reversal_smoothed", ctes(W, _RSI.format("weekly"), f"y as materialized (select *, row_number() {over()}-1 as rn, {rsi_sql(9)} as q from x)", ewm("e", "y", [("q", k.span_alpha(3), "sq")]), recursive=True)
     + f"select y.ticker, y.date, {r('(case when sq>60 then -1e0 when sq<45 then 1e0 else 0e0 end)')} as target from y join e using (ticker,rn)",
     "rsi", v.weekly_bars, period=9, buy_threshold=45, sell_threshold=60, mode="reversal", rsi_smooth=3)
rule("str_roc", ctes(W, f"y as materialized (select *, row_number() {over()}-1 as rn, {ret('close', 7)} as q from weekly)", ewm("e", "y", [("q", k.span_alpha(5), "sq")]), recursive=True)
     + f"select y.ticker, y.date, {r(sig('sq', '0.005'))} as target from y join e using (ticker,rn)", "roc", v.weekly_bars, period=7, threshold=0.005, smoothing=5)
_M, _S = full("avg", "close", 15), full("stddev_samp", "close", 15)
rule("str_bollinger_breakout", ctes(V, f"y as (select *, {_M} as m, {_S} as s from vwap)") + out("(case when close<m-1.5*s and 3*s/(m+1e-10)>0.1 then -1e0 when close>m+1.5*s and 3*s/(m+1e-10)>0.1 then 1e0 else 0e0 end)", "y"),
     "bollinger", v.vwap_bars, period=15, num_std=1.5, band_width_filter=0.1)
rule("str_bollinger_revert", ctes(V, f"y as (select *, {_M} as m, {_S} as s from vwap)") + out("(case when close<m-1.0*s then 1e0 else 0e0 end)", "y"),
     "bollinger", v.vwap_bars, period=15, num_std=1.0, mode="mean_revert", long_short=False)


def donchian_cte(src: str, p: int, e: int, n: int, shorts: bool, name: str = "dc") -> str:
    up = f"coalesce(close>{full('max', 'high', p, 1)},false)"
    dn = f"coalesce(close<{full('min', 'low', p, 1)},false)"
    down = "when s.dn then -1 " if shorts else ""
    leave = "case when (e.st>0 and s.xl) or (e.st<0 and s.xs) then 0 else e.st end"
    return (f"{name}0 as (select *, row_number() {over()}-1 as rn, {up} as u1, {dn} as d1, coalesce(close<{full('min', 'low', e, 1)},false) as xl, coalesce(close>{full('max', 'high', e, 1)},false) as xs from {src}),"
            f"{name}1 as materialized (select *, sum(u1::int) {over(frame=trail(n))}>={n} as up, sum(d1::int) {over(frame=trail(n))}>={n} as dn from {name}0),"
            f"{name} as (select s.ticker, s.date, s.rn, (case when s.up then 1 {down}else 0 end) as st from {name}1 s where s.rn=0 union all "
            f"select s.ticker, s.date, s.rn, case when ({leave})<>0 then ({leave}) when s.up then 1 {down}else 0 end from {name} e join {name}1 s on s.ticker=e.ticker and s.rn=e.rn+1)")


rule("str_donchian", ctes(V, donchian_cte("vwap", 10, 5, 2, True), recursive=True) + out("st", "dc"), "donchian", v.vwap_bars, period=10, exit_period=5, confirmation=2)
rule("str_donchian_long", ctes(W, donchian_cte("weekly", 20, 20, 1, False), recursive=True) + out("st", "dc"), "donchian", v.weekly_bars, long_short=False)
rule("str_dual_momentum", ctes(V) + out(sig(ret("close", 63), "0.02", False), "vwap"), "dual_momentum", v.vwap_bars, abs_threshold=0.02)
_F, _MM, _SL = (full("avg", "close", p) for p in (5, 20, 75))
rule("str_triple_ma", ctes(V, f"y as (select *, {_F} as a, {_MM} as b, {_SL} as c from vwap)") + out("(case when a<b and b<c then -1e0 when a>b and b>c then 1e0 else 0e0 end)", "y"),
     "triple_ma", v.vwap_bars, fast=5, medium=20, slow=75)
_CLIP = "greatest(least({},2e0),-2e0)"
rule("str_vol_scale_mom", ctes(V, f"x as (select *, {ret('close', 1)} as r1 from vwap)", f"y as (select *, {ret('close', 42)} as q, {full('stddev_samp', 'r1', 21)}*sqrt(252.0) as vol from x)")
     + out(_CLIP.format(sig("q", "0.01") + "*coalesce(0.8/(vol+1e-10),0)"), "y"), "vol_scale_mom", v.vwap_bars, lookback=42, vol_lookback=21, vol_target=0.8, threshold=0.01)
rule("str_acceleration", ctes(V) + out(sig(f"({ret('close', 3)}-{ret('close', 14)})", "0.005"), "vwap"), "acceleration", v.vwap_bars, short_lb=3, long_lb=14, threshold=0.005)


def zscore_cte(src: str, p: int, entry: float, leave: float, reversion: bool, shorts: bool) -> str:
    z = f"((close-{full('avg', 'close', p)})/({full('stddev_samp', 'close', p)}+1e-10))"
    buy, sell = (f"s.z<-{entry}", f"s.z>{entry}") if reversion else (f"s.z>{entry}", f"s.z<-{entry}")
    start = f"(case when s.z is null then 0 when {buy} then 1 {'when ' + sell + ' then -1 ' if shorts else ''}else 0 end)"
    return (f"z0 as materialized (select *, row_number() {over()}-1 as rn, {z} as z from {src}),"
            f"zs as (select s.ticker, s.date, s.rn, {start} as st from z0 s where s.rn=0 union all select s.ticker, s.date, s.rn, case when s.z is null then e.st when e.st=0 then {start} "
            f"when abs(s.z)<={leave} then 0 when {sell} then {-1 if shorts else 0} when e.st<0 and {buy} then 1 else e.st end from zs e join z0 s on s.ticker=e.ticker and s.rn=e.rn+1)")


rule("str_zscore", ctes(V, zscore_cte("vwap", 21, 1.0, 0.25, False, True), recursive=True) + out("st", "zs"), "zscore", v.vwap_bars, exit_z=0.25)
rule("str_zscore_reversion", ctes(W, zscore_cte("weekly", 14, 1.5, 0.5, True, False), recursive=True) + out("st", "zs"), "zscore", v.weekly_bars, lookback=14, entry_z=1.5, exit_z=0.5, mode="reversion", long_short=False)
rule("str_heikin_ashi", ctes(W, *[x.replace("{src}", "weekly") for x in HEIKIN], "h4 as (select h2.*, hao from h2 join h3 using (ticker,rn))",
     f"h5 as (select *, {full('avg', 'hac', 3)} as c3, {full('avg', 'hao', 3)} as o3 from h4)",
     f"h6 as (select *, coalesce(sum((c3>o3)::int) {over(frame=trail(2))}>=2,false) as bull, coalesce(sum((c3<o3)::int) {over(frame=trail(2))}>=2,false) as bear from h5)", recursive=True)
     + out("(case when bear then -1e0 when bull then 1e0 else 0e0 end)", "h6"), "heikin_ashi", v.weekly_bars, smooth=3, confirmation=2)
rule("str_supertrend", ctes(W, f"t0 as (select *, {SQL_TR} as tr from weekly)", f"t1 as materialized (select *, row_number() {over()}-1 as rn, (high+low)/2+1.5*{full('avg', 'tr', 7)} as u0, (high+low)/2-1.5*{full('avg', 'tr', 7)} as l0 from t0)",
     """st as (select ticker, date, rn, 0 as tr, u0 as u, l0 as l from t1 where rn=0 union all
 select ticker, date, rn, tr, case when keep and tr=-1 then least(u0,pu) else u0 end, case when keep and tr=1 then greatest(l0,pl) else l0 end from (
  select s.ticker, s.date, s.rn, s.u0, s.l0, e.u as pu, e.l as pl,
   case when e.u is null then 0 when s.close>e.u then 1 when s.close<e.l then -1 when e.tr=0 then 1 else e.tr end as tr,
   (e.u is not null and not (s.close>e.u) and not (s.close<e.l) and e.tr<>0) as keep
  from st e join t1 s on s.ticker=e.ticker and s.rn=e.rn+1))""", recursive=True) + out("tr", "st"), "supertrend", v.weekly_bars, atr_period=7, multiplier=1.5)
_VOTES = [f"(case when close>{full('max', 'high', p, 1)} then 1e0 when close<{full('min', 'low', p, 1)} then -1e0 else 0e0 end)" for p in (5, 10, 20)]
rule("str_multi_breakout", ctes(W, f"y as (select *, ({'+'.join(_VOTES)})/3 as q from weekly)") + out(sig("q", "0.3"), "y"), "multi_breakout", v.weekly_bars, periods=(5, 10, 20), vote_threshold=0.3)
rule("str_ensemble", ctes(W, donchian_cte("weekly", 20, 20, 1, True), f"x as (select *, close-{lag('close')} as dlt from weekly)",
     f"y as (select x.*, {sig(ret('close', 21))}+{sig('(' + rsi_sql(14) + '-50)')} as a from x)", recursive=True)
     + f"select y.ticker, y.date, {r(sig('((y.a+dc.st)/3)', '0.5'))} as target from y join dc using (ticker,date)",
     "ensemble", v.weekly_bars, strategies=("tsmom_21", "rsi_14", "donchian_20"))
rule("str_stacked", ctes(W, f"y as (select *, {sig('(' + full('avg', 'close', 5) + '-' + full('avg', 'close', 21) + ')')} as b, {ret('close', 10)} as m, {full('avg', 'close', 20)} as a from weekly)")
     + out("(case when b>0 and (m is null or a is null or m<=0 or close<a) then 0e0 when b<0 and (m is null or a is null or m>=0 or close>a) then 0e0 else b end)", "y"),
     "stacked", v.weekly_bars, momentum_lb=10, ma_filter=20, base_strategy="ma_cross", base_lookback=21)
_VF, _VS = full("stddev_samp", "r1", 5) + "*sqrt(252.0)", full("stddev_samp", "r1", 63) + "*sqrt(252.0)"
_RAW = "(case when mom<0 then -1e0 when mom>0 then 1e0 else 0e0 end)"
_SZ = "greatest(least(" + _RAW + "*({}/(vf+1e-10)),2e0),-2e0)"
rule("str_regime_aware", ctes(W, *adx_sql("weekly"), ewm("a7", "a6m", [("adx", k.span_alpha(3), "adx3")]).replace("a7 as", "a6m as materialized (select * from a6), a7 as", 1),
     f"w0 as (select *, {ret('close', 1)} as r1 from a2)",
     f"w1 as (select ticker,date,rn,close,{_VF} as vf,{_VS} as vs,{full('avg', 'close', 50)} as m50,{full('avg', 'close', 200)} as m200,{ret('close', 21)} as mom,{ret('close', 3)} as fr from w0)",
     """w2 as (select w1.*, coalesce(vf/(vs+1e-10)>1.2,false) as crisis, coalesce(adx3>15,false) as trending, coalesce(close>m50 and m50>m200 and mom>0,false) as bull,
 coalesce(close<m50 and m50<m200 and mom<0,false) as bear from w1 join a7 using (ticker,rn))""",
     f"""w3 as (select *, case when crisis and not bull then {_SZ.format(0.3)}*0.3 when not trending and bear and not crisis then {_SZ.format(0.9)}*0.5 when trending and bear and not crisis then {_SZ.format(0.9)}
 when not trending and bull and not crisis then {_SZ.format(0.9)} when crisis and bull then {_SZ.format(0.3)} when trending and bull and not crisis then {_SZ.format(0.9)} else 0e0 end as p from w2)""", recursive=True)
     + out("(case when coalesce(fr<-0.02,false) and p>0 then p*0.3 else p end)", "w3"), "regime_aware", v.weekly_bars, adx_trend_threshold=15, adx_smooth=3, vol_fast=5, crisis_vol_mult=1.2,
     mom_lookback=21, vol_target_normal=0.9, vol_target_crisis=0.3, fast_exit_days=3, fast_exit_threshold=-0.02, bearish_mode="short")


@query("str_baselines", ctes(W) + "select ticker, date, 'cash' as strategy, 0e0 as target from weekly union all select ticker, date, 'buy_and_hold', 1e0 from weekly")
def _(t):
    from ..operators.ledger import buy_and_hold, cash_only
    b = v.weekly_bars(t).select("ticker", "date")
    return cash_only(b).withColumn("strategy", F.lit("cash")).unionByName(buy_and_hold(b).withColumn("strategy", F.lit("buy_and_hold"))).select("ticker", "date", "strategy", "target")
