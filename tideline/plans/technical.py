"""Kernels, indicators and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..operators import indicators as ind
from ..operators.features import BAND_WIDTHS, BANDS, MA_DISTANCE, MACD, MACD_SIGNAL, RANGE, RETURNS, ROC, RSI, VOLATILITY, VOLUME, band_name, compute_features
from . import views as v
from .registry import ctes, ewm, full, lag, over, query, r, ret, rounded, trail
from .sqlparts import CUM



def W():
    return k.over_time()


def SEQ():
    return k.over_time(("ticker",), k.RECURSION_ORDER)


def ranked(src: str, name: str = "src", extra: str = "") -> str:
    return f"{name} as materialized (select *, row_number() over (partition by ticker order by date)-1 as rn{extra} from {src})"


@query("wk_lags_and_returns", ctes(v.SQL_BARS) + f"""select ticker, date, {lag('close', 3)} as back3, lead(close,2) {over()} as ahead2, {r(ret('close', 5))} as ret5,
 {r(ret('close', 10, 2))} as ret10_skip2, {r('close-' + lag('close', 4), 4)} as diff4, cast(row_number() {over()} as integer) as ordinal from bars""")
def _(t):
    b = v.order_bars(t)
    return rounded(b.select("ticker", "date", k.shifted("close", 3, W()).alias("back3"), k.shifted("close", -2, W()).alias("ahead2"),
                            k.simple_return("close", 5, W()).alias("ret5"), k.simple_return("close", 10, W(), 2).alias("ret10_skip2"),
                            k.difference("close", 4, W()).alias("diff4"), F.row_number().over(W()).alias("ordinal")), 6, diff4=4)


@query("wk_rolling", ctes(v.SQL_BARS) + f"""select ticker, date, {r(full('avg', 'close', 20), 4)} as sma20, {r(full('stddev_samp', 'close', 20), 4)} as std20,
 {full('max', 'high', 20, 1)} as max20, {full('min', 'low', 20, 1)} as min20,
 coalesce(sum(case when volume>1 then 1 else 0 end) {over(frame=trail(3))}>=3,false) as confirmed3 from bars""")
def _(t):
    b = v.order_bars(t)
    return rounded(b.select("ticker", "date", k.sma("close", 20, W()).alias("sma20"), k.rolling_std("close", 20, W()).alias("std20"),
                            k.rolling_max("high", 20, W(), 1).alias("max20"), k.rolling_min("low", 20, W(), 1).alias("min20"),
                            k.confirmed(F.col("volume") > 1, 3, W()).alias("confirmed3")), 4)


A12, A26, A3 = 2.0 / 13.0, 2.0 / 27.0, 2.0 / 4.0
A250 = 2.0 / 251.0


@query("wk_ewm", ctes(v.SQL_BARS, ranked("bars"), ewm("e", "src", [("close", A12, "ema12"), ("close", A250, "ema250"), ("close", 1 / 14, "wilder14")]),
    "e1 as materialized (select * from e)", ewm("f", "e1", [("ema12", A12, "ee")]), recursive=True)
       + f"select s.ticker, s.date, {r('e.ema12', 4)} as ema12, {r('e.ema250', 4)} as ema250, {r('e.wilder14', 4)} as wilder14, {r('2*e.ema12-f.ee', 4)} as dema12 from src s join e using (ticker,rn) join f using (ticker,rn)")
def _(t):
    df = ind.with_moving_averages(v.order_bars(t), [("ema", 12, "ema12"), ("ema", 250, "ema250"), ("dema", 12, "dema12")])
    df = k.with_ewm(df, [("close", k.wilder_alpha(14), "wilder14")])
    return rounded(df.select("ticker", "date", "ema12", "ema250", "wilder14", "dema12"), 4)


@query("wk_wma", ctes(v.SQL_BARS) + f"""select ticker, date, close as wma1, {r("(" + "+".join(f"{10 - i}*{lag('close', i) if i else 'close'}" for i in range(10)) + ")/55", 4)} as wma10 from bars""")
def _(t):
    df = ind.with_moving_averages(v.order_bars(t), [("wma", 1, "wma1"), ("wma", 10, "wma10")])
    return rounded(df.select("ticker", "date", "wma1", "wma10"), 4)


@query("wk_cumulative", ctes(v.SQL_WEEKLY, f"x as (select *, coalesce({ret('close', 1)},0)*3 as rr from weekly)", f"y as (select *, product(1+greatest(rr,-1)) {over(frame=CUM)} as eq from x)") + f"""
 select ticker, date, {r('eq')} as equity, {r(f'greatest(max(eq) {over(frame=CUM)},1)')} as peak, last_value(case when volume>25000 then volume end ignore nulls) {over(frame=CUM)} as last_busy from y""")
def _(t):
    df = v.weekly_bars(t).withColumn("rr", F.coalesce(k.simple_return("close", 1, W()), F.lit(0.0)) * 3)
    df = df.withColumn("equity", k.growth("rr", W()))
    return rounded(df.select("ticker", "date", "equity", k.running_peak("equity", W()).alias("peak"),
                             k.forward_fill(F.when(F.col("volume") > 25000, F.col("volume")), W()).alias("last_busy")))


@query("wk_vol_target", ctes(v.SQL_VWAP, f"x as (select *, coalesce({ret('close', 1)},0) as rr from vwap)") + f"select ticker,date, {r('coalesce(0.15/(' + full('stddev_samp', 'rr', 21) + '*sqrt(252.0)+1e-10),0)')} as scale from x")
def _(t):
    df = v.vwap_bars(t).withColumn("rr", F.coalesce(k.simple_return("close", 1, W()), F.lit(0.0)))
    return rounded(df.select("ticker", "date", k.vol_scale("rr", 21, 0.15, "ann", W()).alias("scale")))


# --- indicators -------------------------------------------------------------------------------------------------------

SQL_TR = f"greatest(high-low, abs(high-{lag('close')}), abs(low-{lag('close')}))"


def rsi_sql(p: int, d: str = "dlt") -> str:
    up, down = full("avg", f"(case when {d} is not null then greatest({d},0) end)", p), full("avg", f"(case when {d} is not null then greatest(-{d},0) end)", p)
    return f"(100-100/(1+{up}/({down}+1e-10)))"


@query("ind_core", ctes(v.SQL_BARS, f"x as (select *, {SQL_TR} as tr, close-{lag('close')} as dlt, {ret('close', 1)} as r1 from bars)") + f"""
 select ticker, date, {r('tr', 4)} as tr, {r(full('avg', 'tr', 14), 4)} as atr14, {r(rsi_sql(14))} as rsi14,
 {r('(close-' + full('avg', 'close', 21) + ')/(' + full('stddev_samp', 'close', 21) + '+1e-10)')} as z21,
 {r(full('stddev_samp', 'r1', 21) + '*sqrt(252.0)')} as vol21,
 {r(full('avg', 'close', 20) + '+2*' + full('stddev_samp', 'close', 20), 4)} as upper20,
 {r('4*' + full('stddev_samp', 'close', 20) + '/(' + full('avg', 'close', 20) + '+1e-10)')} as width20 from x""")
def _(t):
    df = ind.with_atr(v.order_bars(t), [("sma", 14, "atr14")])
    df = ind.with_rsi(df, [14], "rsi").withColumns({"r1": k.simple_return("close", 1, SEQ()), "ann": F.lit(252.0)})
    bands = ind.bollinger("close", 20, 2.0, SEQ())
    return rounded(df.select("ticker", "date", ind.true_range(SEQ()).alias("tr"), "atr14", "rsi14", ind.zscore("close", 21, SEQ()).alias("z21"),
                             ind.volatility("r1", 21, SEQ()).alias("vol21"), bands["upper"].alias("upper20"), bands["bandwidth"].alias("width20")),
                   6, tr=4, atr14=4, upper20=4)


SQL_ADX = (
    f"a0 as (select *, high-{lag('high')} as up, {lag('low')}-low as dn, {SQL_TR} as tr from {{src}})",
    "a1 as (select *, case when up>dn and up>0 then up else 0.0 end as pdm, case when dn>up and dn>0 then dn else 0.0 end as ndm from a0)",
    ranked("a1", "a2"),
    ewm("a3", "a2", [("tr", 1 / 14, "atr"), ("pdm", 1 / 14, "p"), ("ndm", 1 / 14, "n")]),
    "a4 as (select *, 100*p/(atr+1e-10) as pdi, 100*n/(atr+1e-10) as ndi from a3)",
    "a5 as materialized (select *, 100*abs(pdi-ndi)/(pdi+ndi+1e-10) as dx from a4)",
    ewm("a6", "a5", [("dx", 1 / 14, "adx")]),
)


def adx_sql(src: str) -> tuple[str, ...]:
    return tuple(x.replace("{src}", src) for x in SQL_ADX)


@query("ind_adx", ctes(v.SQL_WEEKLY, *adx_sql("weekly"), recursive=True) + f"select a2.ticker, a2.date, {r('a6.adx')} as adx from a2 join a6 using (ticker,rn)")
def _(t):
    return rounded(ind.with_adx(v.weekly_bars(t), 14).select("ticker", "date", "adx"))


@query("ind_macd", ctes(v.SQL_BARS, ranked("bars"), ewm("e", "src", [("close", A12, "f"), ("close", A26, "s")]), "m as materialized (select *, f-s as line from e)",
    ewm("g", "m", [("line", 2.0 / 10.0, "sig")]), recursive=True) + f"select src.ticker, src.date, {r('m.line', 4)} as macd_line, {r('g.sig', 4)} as macd_signal_9 from src join m using (ticker,rn) join g using (ticker,rn)")
def _(t):
    return rounded(ind.with_macd(v.order_bars(t), 12, 26, [9], "macd_").select("ticker", "date", "macd_line", "macd_signal_9"), 4)


HEIKIN = (f"h0 as (select *, (open+high+low+close)/4 as hac from {{src}})", f"h1 as (select *, coalesce({lag('hac')},(open+close)/2) as prv from h0)", ranked("h1", "h2"),
          ewm("h3", "h2", [("prv", 0.5, "hao")]))


@query("ind_heikin_ashi", ctes(v.SQL_BARS, *[x.replace("{src}", "bars") for x in HEIKIN], recursive=True)
       + f"select h2.ticker, h2.date, {r('hac', 4)} as ha_close, {r('hao', 4)} as ha_open from h2 join h3 using (ticker,rn)")
def _(t):
    return rounded(ind.with_heikin_ashi(v.order_bars(t)).select("ticker", "date", "ha_close", "ha_open"), 4)


# --- features ---------------------------------------------------------------------------------------------------------

SPANS = sorted({x for p in MACD for x in p})


def features_cte(src: str) -> tuple[str, ...]:
    """CTEs ending in ``feat`` (ticker, date, rn, all features unrounded)."""
    pieces = [f"{ret('close', p)} as ret_{p}" for p in RETURNS]
    pieces += [f"(close-{full('avg', 'close', p)})/{full('avg', 'close', p)} as ma_dist_{p}" for p in MA_DISTANCE]
    pieces += [f"{rsi_sql(p)} as rsi_{p}" for p in RSI]
    pieces += [f"{full('stddev_samp', 'r1', p)}*sqrt(252.0) as vol_{p}" for p in VOLATILITY]
    for p in BANDS:
        m, s = full("avg", "close", p), full("stddev_samp", "close", p)
        pieces += [f"(close-({m}-{n}*{s}))/(2*{n}*{s}+1e-10) as {band_name(p, n)}" for n in BAND_WIDTHS]
    pieces += [f"({ret('close', p)})*100 as roc_{p}" for p in ROC]
    pieces += [f"volume/({full('avg', 'volume', p)}+1e-10) as vol_ratio_{p}" for p in VOLUME]
    pieces += [f"{ret('close', 5)}-{ret('close', 10)} as acceleration"]
    pieces += [f"({full('max', 'high', p)}-{full('min', 'low', p)})/close as range_{p}" for p in RANGE]
    lines = ", ".join(f"e{f}-e{s} as l{f}_{s}" for f, s in MACD)
    macd = ", ".join(f"f1.l{f}_{s}-f2.s{f}_{s}_{g} as macd_{f}_{s}_{g}" for f, s in MACD for g in MACD_SIGNAL)
    return (
        f"f0 as materialized (select *, close-{lag('close')} as dlt, {ret('close', 1)} as r1, row_number() over (partition by ticker order by date)-1 as rn from {src})",
        ewm("fe", "f0", [("close", k.span_alpha(p), f"e{p}") for p in SPANS]),
        f"f1 as materialized (select ticker, rn, {lines} from fe)",
        ewm("f2", "f1", [(f"l{f}_{s}", k.span_alpha(g), f"s{f}_{s}_{g}") for f, s in MACD for g in MACD_SIGNAL]),
        f"f3 as materialized (select ticker, date, rn, {', '.join(pieces)} from f0)",
        f"feat as materialized (select f3.*, {macd} from f3 join f1 using (ticker,rn) join f2 using (ticker,rn))",
    )


def _names():
    from ..operators.features import feature_names
    return feature_names()


@query("fea_table", ctes(v.SQL_WEEKLY, *features_cte("weekly"), recursive=True) + "select ticker, date, " + ", ".join(f"{r(n, 5)} as {n}" for n in _names()) + " from feat")
def _(t):
    return rounded(compute_features(v.weekly_bars(t)), 5)
