"""Flagship, sources, splits, parameter tables and as-of joins."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.scalars import annualization
from ..operators import grid as g
from ..operators.ledger import LedgerOptions
from ..operators.metrics import period_metrics
from ..operators.schedules import accrual, as_of
from ..operators.search import candidate_table, ledger_of, remaining
from ..operators.splits import execution_model, halving_resources, prefix, with_folds, with_periods
from ..operators.strategies import STRATEGIES
from ..sources import bars as src
from . import views as v
from .registry import Tables, big, ctes, full, lag, query, r, rounded
from .sqlparts import RETURN_COLS, ledger_sql, metrics_sql, periods_sql

OPTS = LedgerOptions(cost_bps=1.0, slippage_bps=0.5, spread_bps=2.0, execution_lag=1)
K_OPTS = "0.00025"

MA_CROSS_SQL = f"""sig as materialized (select *, case when {full('avg', 'close', 5)}>{full('avg', 'close', 20)} then 1.0 else 0.0 end as target from vwap)"""


@query("flagship_ma_cross", ctes(v.SQL_VWAP, MA_CROSS_SQL, ledger_sql("sig", lag=1, k=K_OPTS), metrics_sql("led"))
       + f"""select ticker, n_observations, trade_count, {r('exposure')} as exposure, {r('turnover', 4)} as turnover,
 {r('transaction_cost_drag')} as transaction_cost_drag, case when undefined_ then -99.0 else sharpe0 end as sharpe, {RETURN_COLS} from met""")
def flagship(t: Tables) -> DataFrame:
    led = ledger_of(v.vwap_bars(t), "ma_cross", OPTS, fast=5, slow=20, long_short=False)
    m = period_metrics(led, ("ticker",))
    return rounded(m.select("ticker", "n_observations", "trade_count", "exposure", "turnover", "transaction_cost_drag",
                            "sharpe", *RETURN_COLS.replace(" ", "").split(",")), 6, turnover=4)


# --- sources ----------------------------------------------------------------------------------------------------------

@query("src_daily_bars", ctes(v.SQL_BARS) + "select * from bars")
def _(t):
    return v.order_bars(t)


@query("src_vwap_bars", ctes(v.SQL_VWAP) + f"select ticker,date,{r('open')} as open,{r('high')} as high,{r('low')} as low,{r('close')} as close,volume from vwap")
def _(t):
    return rounded(v.vwap_bars(t).drop("ann"))


@query("src_weekly_bars", ctes(v.SQL_WEEKLY) + f"select ticker,date,{r('open')} as open,{r('high')} as high,{r('low')} as low,{r('close')} as close,volume from weekly")
def _(t):
    return rounded(v.weekly_bars(t).drop("ann"))


SQL_LINES = """ln as materialized (select o_orderpriority as ticker, (case when o_orderkey%11=0 then strftime(o_orderdate,'%d.%m.%Y') else strftime(o_orderdate,'%Y-%m-%d') end)
 ||','||cast(o_custkey as varchar)||','||cast(o_custkey+o_orderkey%3-(case when o_orderkey%13=0 then 2 else 0 end) as varchar)||','||(case when o_orderkey%17=0 then '-1' else cast(o_custkey as varchar) end)
 ||','||(case when o_orderkey%19=0 then 'n/a' else cast(o_custkey as varchar) end)||','||(case when o_orderkey%23=0 then '-5' else cast(o_custkey%100 as varchar) end) as line from orders)"""


@query("src_csv_contract", ctes(SQL_LINES, """cl as (select ticker, split_part(line,',',1) as date, try_cast(split_part(line,',',2) as double) as open, try_cast(split_part(line,',',3) as double) as high, try_cast(split_part(line,',',4) as double) as low,
 try_cast(split_part(line,',',5) as double) as close, try_cast(split_part(line,',',6) as double) as volume from ln)""",
    "nb as (select *, row_number() over (partition by ticker, date order by open nulls first, high nulls first, low nulls first, close nulls first) as k from cl)",
    """fl as (select ticker, list_filter([case when not regexp_matches(date,'^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then 'date' end, case when not coalesce(open>0 and high>0 and low>0 and close>0,false) then 'price' end,
 case when not coalesce(high>=greatest(open,low,close) and low<=least(open,high,close),true) then 'range' end, case when volume<0 then 'volume' end, case when k>1 then 'duplicate' end], lambda x: x is not null) as p from nb)""")
    + "select ticker, problem, count(*) as rows from (select ticker, unnest(p) as problem from fl) group by 1,2")
def _(t):
    """Bar lines as text with foreign dates, inverted ranges, negative and unreadable numbers and repeated days."""
    key = F.col("o_orderkey")
    day = F.when(key % 11 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    whole = lambda c: c.cast("bigint").cast("string")
    cust = F.col("o_custkey")
    line = F.concat_ws(",", day, whole(cust), whole(cust + key % 3 - F.when(key % 13 == 0, 2).otherwise(0)), F.when(key % 17 == 0, "-1").otherwise(whole(cust)),
                       F.when(key % 19 == 0, "n/a").otherwise(whole(cust)), F.when(key % 23 == 0, "-5").otherwise(whole(cust % 100)))
    rows = src.bars_from_csv_lines(t.orders.select(F.col("o_orderpriority").alias("ticker"), line.alias("line")))
    return rows.select("ticker", F.explode("problems").alias("problem")).groupBy("ticker", "problem").agg(F.count(F.lit(1)).alias("rows"))


@query("src_clean_provider_rows", ctes(v.SQL_QUOTES) + f"""select ticker,date,{r('open')} as open,{r('high')} as high,{r('low')} as low,{r('close')} as close,{r('volume')} as volume
 from (select *, row_number() over (partition by ticker,date order by quote_id desc, close nulls last) as k from quotes
  qualify k=1) where open is not null and high is not null and low is not null and close is not null""")
def _(t):
    # the line number is not unique within an order, so the ingest order is completed by the price
    q = v.quotes(t).withColumn("seq", F.struct("quote_id", F.col("close").isNotNull(), -F.coalesce("close", F.lit(0.0))))
    upper = q.withColumnsRenamed({"open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "date": "Date"})
    return rounded(src.clean_provider_rows(upper, "seq"))


@query("src_range_coverage", ctes(v.SQL_BARS, """req as (select distinct o_orderpriority as ticker, date '1995-01-01' as start_, date '1998-08-02' as end_ from orders
 union all select l_returnflag||l_linestatus, date '1990-03-03', max(cast(l_shipdate as date)) from lineitem group by 1)""",
    "st as (select ticker,date from bars union all select l_returnflag||l_linestatus, cast(l_shipdate as date) from lineitem)",
    "b as (select ticker,min(date) as first_date,max(date) as last_date from st group by 1)") + """
 select req.ticker, first_date, last_date,
 case dayofweek(start_) when 6 then start_+2 when 0 then start_+1 else start_ end as start_edge,
 case dayofweek(end_) when 6 then end_-1 when 0 then end_-2 else end_ end as end_edge,
 coalesce(first_date-start_edge<=7,false) as start_ok, coalesce(last_date>=end_edge,false) as end_ok,
 first_date is not null and start_ok and end_ok as covered from req left join b using (ticker)""")
def _(t):
    a = v.order_bars(t).select("ticker", "date")
    b = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
    r1 = a.select("ticker").distinct().select("ticker", F.lit("1995-01-01").cast("date").alias("start"), F.lit("1998-08-02").cast("date").alias("end"))
    r2 = b.groupBy("ticker").agg(F.lit("1990-03-03").cast("date").alias("start"), F.max("date").alias("end"))
    out = src.range_coverage(a.unionByName(b), r1.unionByName(r2), F.lit("2026-01-01").cast("date"))
    return out.select("ticker", "first_date", "last_date", "start_edge", "end_edge", "start_ok", "end_ok", "covered")


@query("src_json_bars", ctes(v.SQL_BARS) + "select ticker,date,open,high,low,close,volume from bars")
def _(t):
    # bars written as JSON rows per ticker and month (at most 31), then read back
    cells = F.array(F.col("date").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    months = v.order_bars(t).groupBy("ticker", F.date_trunc("month", "date").alias("m")).agg(F.to_json(F.collect_list(cells)).alias("payload"))
    return src.bars_from_json(months)


_CENTS = "cast(round({}*100) as bigint)"


@query("src_fingerprint", ctes(v.SQL_BARS, f"""x as (select ticker, cast(date as varchar)||'|'||{_CENTS.format('open')}||'|'||{_CENTS.format('high')}||'|'||{_CENTS.format('low')}||'|'||{_CENTS.format('close')} as s from bars)""")
       + """select ticker, count(*) as row_count, bit_xor(cast('0x'||substr(sha256(s),1,15) as bigint)) as digest,
 sha256('date|open|high|low|close:'||count(*)||':'||bit_xor(cast('0x'||substr(sha256(s),1,15) as bigint))) as fingerprint from x group by ticker""")
def _(t):
    cents = v.order_bars(t).select("ticker", "date", *[F.round(F.col(c) * 100).cast("bigint").alias(c) for c in src.OHLC])
    return src.fingerprint(cents)


@query("src_price_fallback", ctes(v.SQL_QUOTES) + f"""select quote_id, {r('coalesce(open,close)')} as open, {r('coalesce(high,close)')} as high, {r('coalesce(low,close)')} as low, {r('close')} as close
 from (select quote_id, case when volume is null then null else open end as open, case when volume is null then null else high end as high, low, close from quotes)""")
def _(t):
    q = v.quotes(t).withColumns({c: F.when(F.col("volume").isNotNull(), F.col(c)) for c in ("open", "high")})
    return rounded(src.with_price_fallback(q).select("quote_id", "open", "high", "low", "close"))


@query("snk_results_latest", ctes(v.SQL_BARS) + """select ticker, date, close, volume, run from (
 select *, row_number() over (partition by ticker,date order by run desc) k from (
  select ticker,date,close,volume,1 as run from bars union all
  select ticker,date,close*2,volume,2 as run from bars where volume>1)) where k=1""")
def _(t):
    b = v.order_bars(t)
    runs = b.select("ticker", "date", "close", "volume", F.lit(1).alias("run")).unionByName(
        b.filter("volume > 1").select("ticker", "date", (F.col("close") * 2).alias("close"), "volume", F.lit(2).alias("run")))
    from ..sources.sinks import latest
    return latest(runs, ("ticker", "date"), "run")


# --- splits and projections -------------------------------------------------------------------------------------------

@query("prj_date_slice", ctes(v.SQL_BARS) + "select * from bars where date between date '1996-02-01' and date '1997-06-30'")
def _(t):
    return src.slice_dates(v.order_bars(t), "1996-02-01", "1997-06-30")


@query("prj_periods_and_folds", ctes(v.SQL_BARS, periods_sql("bars", folds=4)) + "select ticker,date,period,cast(fold as integer) as fold from per")
def _(t):
    return with_folds(with_periods(v.order_bars(t)), 4).select("ticker", "date", "period", "fold")


@query("prj_halving_resources", ctes(v.SQL_BARS, periods_sql("bars"), """tot as (select ticker, count(*) as n from per where period='val' group by 1)""",
    "s as (select distinct ticker, n, least(n, greatest(2, cast(ceil(n/pow(3.0,k)) as bigint))) as resource_bars from tot, (select unnest([0,1,2]) as k))")
    + "select ticker, n, cast(row_number() over (partition by ticker order by resource_bars)-1 as integer) as stage, resource_bars from s")
def _(t):
    tot = with_periods(v.order_bars(t)).filter("period = 'val'").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return halving_resources(tot, "n")


@query("prj_prefix", ctes(v.SQL_BARS, periods_sql("bars"), "c as (select ticker,max(date) as cutoff from per where period='train' group by 1)")
       + "select bars.* from bars join c using (ticker) where date<=cutoff")
def _(t):
    b = v.order_bars(t)
    cut = with_periods(b).filter("period = 'train'").groupBy("ticker").agg(F.max("date").alias("cutoff"))
    return prefix(b, cut)


@query("prj_execution_models", ctes(v.SQL_BARS) + """select ticker,date,'same_close' as model,close as fill,close as signal_close from bars
 union all select ticker,date,'next_close',close,lag(close,1) over w from bars window w as (partition by ticker order by date)
 union all select ticker,date,'next_open',open,lag(close,1) over w from bars window w as (partition by ticker order by date)
 union all select ticker,date,'delayed_close',close,lag(close,3) over w from bars window w as (partition by ticker order by date)""")
def _(t):
    b, w, out = v.order_bars(t), k.over_time(), None
    for m in ("same_close", "next_close", "next_open", "delayed_close"):
        n, price = execution_model(m, 3)
        part = b.select("ticker", "date", F.lit(m).alias("model"), F.col(price).alias("fill"), k.shifted("close", n, w).alias("signal_close"))
        out = part if out is None else out.unionByName(part)
    return out


@query("prj_annualization", """select c_custkey, upper(c_mktsegment)||'-'||cur as ticker, case when cur in ('USD','EUR','BTC') then 365e0 else 252e0 end as annualization
 from (select c_custkey, c_mktsegment, case when c_acctbal<0 then 'USD' when c_acctbal<2000 then 'EUR' when c_acctbal<4000 then 'BTC' when c_acctbal<6000 then 'XYZ' else 'US' end as cur from customer)""")
def _(t):
    a = F.col("c_acctbal")
    cur = F.when(a < 0, "USD").when(a < 2000, "EUR").when(a < 4000, "BTC").when(a < 6000, "XYZ").otherwise("US")
    d = t.customer.select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("-"), cur).alias("ticker"))
    return d.withColumn("annualization", annualization(F.col("ticker")))


def _literal(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return repr(x) if isinstance(x, int | float) else "'" + (x if isinstance(x, str) else json.dumps(x)) + "'"


#: which combinations of a grid are candidates, as SQL
_VALID = {"ma_cross": "fast<slow", "macd": "fast<slow", "rsi": "case when mode='momentum' then buy_threshold>=sell_threshold else buy_threshold<=sell_threshold end",
          "triple_ma": "fast<medium and medium<slow", "acceleration": "short_lb<long_lb", "zscore": "entry_z>=exit_z"}


def _count_sql(name: str) -> str:
    tables = [f"(values {','.join(f'({_literal(x)})' for x in values)}) as d{i}({dim})" for i, (dim, values) in enumerate(STRATEGIES[name].full_grid().items())]
    return f"select '{name}' as strategy, count(*) as candidates from {','.join(tables)} where {_VALID.get(name, 'true')}"


@query("prj_grid_counts", "select strategy, ticker, candidates from (" + " union all ".join(_count_sql(n) for n in STRATEGIES if not n.startswith("ml_"))
       + ") s, (select distinct o_orderpriority as ticker from orders)")
def _(t):
    bars, out = t.orders.select(F.col("o_orderpriority").alias("ticker")), None
    for name in STRATEGIES:
        if not name.startswith("ml_"):
            part = candidate_table(bars, name).groupBy("strategy", "ticker").agg(F.count(F.lit(1)).alias("candidates"))
            out = part if out is None else out.unionByName(part)
    return out


_MA_GRID_SQL = """grid as (select f.f as fast, s.s as slow, t.t as ma_type, l.l as long_short, z.z as signal_smooth from
 (select unnest([1,2,3,5,8,10,13,15,20,25,30]) f) f, (select unnest([10,15,20,30,50,75,100,150,200,250]) s) s,
 (select unnest(['sma','ema','wma','dema']) t) t, (select unnest([true,false]) l) l, (select unnest([0,2,3,5,10]) z) z where f.f<s.s),
named as (select *, '{"fast":'||fast||',"long_short":'||long_short||',"ma_type":"'||ma_type||'","signal_smooth":'||signal_smooth||',"slow":'||slow||'}' as params from grid),
tickers as (select distinct o_orderpriority as ticker from orders)"""


@query("prj_canonical_params", ctes(_MA_GRID_SQL) + "select ticker, params from named, tickers")
def _(t):
    return candidate_table(v.order_bars(t), "ma_cross").select("ticker", "params")


@query("jn_resume_remaining", ctes(_MA_GRID_SQL, """done as (select ticker, params from named, tickers where fast<10 and ma_type<>'wma' and ticker<'3')""")
       + "select ticker, params from named, tickers where (ticker,params) not in (select (ticker,params) from done)")
def _(t):
    bars = v.order_bars(t)
    p = F.from_json("params", "fast int, ma_type string")
    done = candidate_table(bars, "ma_cross").filter((p.fast < 10) & (p.ma_type != "wma") & (F.col("ticker") < "3"))
    return remaining(bars, "ma_cross", done).select("ticker", "params")


@query("prj_params_text", """select c_custkey, 'balance='||format('{:.3f}',c_acctbal)||', nation='||c_nationkey||', rich='||case when c_acctbal>5000 then 'T' else 'F' end as label from customer""")
def _(t):
    d = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 5000).alias("rich"))
    return d.select("c_custkey", g.params_text(d, {"balance": "double", "nation": "int", "rich": "boolean"}).alias("label"))


@query("prj_param_neighbours", """with p as (select c_custkey, c_nationkey as fast, c_acctbal/10000 as threshold, c_mktsegment as mode from customer),
m as (select p.*, u.moved, d.direction from p, (select unnest(['fast','threshold']) as moved) u, (select unnest([-1,1]) as direction) d),
n as (select *, case when moved='fast' then fast+direction*greatest(abs(fast)*0.2,1.0) end as mv, abs(threshold)*0.2 as step from m)
select c_custkey, moved, direction, mode, cast(case when moved='fast' then (case when round_even(mv,0)=fast then fast+direction else round_even(mv,0) end) else fast end as bigint) as fast,
 """ + r("case when moved='threshold' then threshold+direction*step else threshold end", 9) + """ as threshold from n
 where (moved='fast' and not (fast>=0 and (case when round_even(mv,0)=fast then fast+direction else round_even(mv,0) end)<0)) or (moved='threshold' and step>0)""")
def _(t):
    d = t.customer.select("c_custkey", F.col("c_nationkey").alias("fast"), (F.col("c_acctbal") / 10000).alias("threshold"), F.col("c_mktsegment").alias("mode"))
    return rounded(g.neighbour_rows(d, {"fast": "int", "threshold": "double"}), 9).withColumn("fast", big("fast"))


def _sample_sql(name: str, k: int = 5, valid: str = "true") -> str:
    """The same design over the whole grid in SQL; which stratum a slot asks of a dimension is a constant of the name."""
    grid = STRATEGIES[name].full_grid()
    h = lambda text: f"cast('0x'||substr(md5({text}),1,8) as bigint)"
    tables, strata, pid = [], [], "0"
    for i, (dim, values) in enumerate(grid.items()):
        rows = ",".join(f"({j},{'true' if x is True else 'false' if x is False else repr(x)},'{json.dumps(x)}')" for j, x in enumerate(values))
        tables.append(f"(values {rows}) as d{i}(i{i},{dim},j{i})")
        pid = f"({pid})*{len(values)}+i{i}"
        asked = [j for _, j in sorted((int(hashlib.md5(f"{name}:{i}:{j}".encode()).hexdigest()[:8], 16), j) for j in range(k))]
        strata.append(f"abs({asked}[slot+1]-i{i}*{k}//{len(values)})")
    text = "||','||".join(f"'{json.dumps(dim)}:'||j{list(grid).index(dim)}" for dim in sorted(grid))
    return f"""select ticker, '{name}' as strategy, params from (select params from (select *, row_number() over (partition by slot order by miss, {h(f"'{name}:row:'||pid")}, pid) as turn from
 (select pid, params, slot, {'+'.join(strata)} as miss from (select {pid} as pid, '{{'||{text}||'}}' as params, * from {','.join(tables)} where {valid}), (select unnest(range({k})) as slot)
 qualify row_number() over (partition by pid order by miss, {h(f"'{name}:slot:'||pid||':'||slot")}, slot)=1)) where turn<={k} order by turn, miss, slot limit {k}) x,
 (select distinct o_orderpriority as ticker from orders) y"""


@query("prj_quick_sample", " union all ".join((_sample_sql("tsmom"), _sample_sql("ma_cross", valid="fast<slow"), _sample_sql("rsi", valid=_VALID["rsi"]))))
def _(t):
    """Five distinct, well-spread candidates per strategy, evaluated per ticker by the search queries."""
    tickers, out = t.orders.select(F.col("o_orderpriority").alias("ticker")).distinct(), None
    for name in ("tsmom", "ma_cross", "rsi"):
        s = STRATEGIES[name]
        full_grid = s.full_grid()
        draws = g.quick_sample(g.build_grid(t.spark, full_grid, s.valid), full_grid, 5, name).select("pid")
        rows = g.build_grid(tickers, full_grid, s.valid).join(F.broadcast(draws), "pid", "left_semi")
        rows = rows.select("ticker", F.lit(name).alias("strategy"), "params")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- schedules --------------------------------------------------------------------------------------------------------

@query("jn_asof_rate", ctes(v.SQL_BARS, v.SQL_RATES) + "select bars.ticker, bars.date, rates.value as rate from bars asof join rates on bars.date>=rates.effective_at")
def _(t):
    return as_of(v.order_bars(t), v.rates(t), "rate").select("ticker", "date", "rate")


@query("jn_asof_borrow_flag", ctes(v.SQL_BARS, v.SQL_RATES) + "select bars.ticker, bars.date, rates.value<0.05 as available from bars asof join rates on bars.date>=rates.effective_at")
def _(t):
    flags = v.rates(t).select("effective_at", (F.col("value") < 0.05).alias("value"))
    return as_of(v.order_bars(t), flags, "available").select("ticker", "date", "available")


@query("jn_rate_accrual", ctes(v.SQL_BARS, v.SQL_RATES, """iv as (select effective_at as a, coalesce(lead(effective_at) over (order by effective_at), timestamp '2100-01-01') as b, value from rates)""",
    f"seg as (select ticker,date,{lag('date')} as prev from bars)") + f"""select seg.ticker, seg.date,
 {r("coalesce(sum(iv.value*epoch(least(iv.b,cast(seg.date as timestamp))-greatest(iv.a,cast(seg.prev as timestamp)))/31557600.0),0)", 10)} as accrued
 from seg left join iv on iv.a<seg.date and iv.b>seg.prev group by 1,2""")
def _(t):
    return rounded(accrual(v.order_bars(t), v.rates(t), "accrued").select("ticker", "date", "accrued"), 10)


@query("jn_positions_forward_fill", ctes(v.SQL_BARS) + """select ticker, date, coalesce(last_value(p ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row),0)+0.0 as target
 from (select bars.ticker, bars.date, case when dayofmonth(bars.date)<=3 and bars.date>='1995-02-01' then (case when volume>2 then 1e0 else -5e-1 end) end as p from bars)""")
def _(t):
    from ..operators.ledger import align_positions
    b = v.order_bars(t)
    pos = b.filter((F.dayofmonth("date") <= 3) & (F.col("date") >= "1995-02-01")).select(
        "ticker", "date", F.when(F.col("volume") > 2, 1.0).otherwise(-0.5).alias("target"))
    return align_positions(b, pos).select("ticker", "date", "target")
