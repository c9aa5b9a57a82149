"""Block bootstrap of selected strategies against buy-and-hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as b
from ..operators import reports
from ..operators.ledger import against_benchmark, with_market
from ..operators.search import positions
from ..operators.splits import with_periods
from . import views as v
from .accounts import REAL, REAL_SQL, TS
from .registry import ctes, query, r, rounded
from .sqlparts import ledger_sql, periods_sql

OPTS = b.BootstrapOptions(n_resamples=400, block_length=10, confidence_level=0.95, seed=7)
KEYS = ("ticker", "period")


def paired(t):
    """Returns of the momentum rule and of buy-and-hold per (ticker, period); windows never cross a period."""
    bars = v.weekly_bars(t)
    target = positions(bars, "tsmom", lookback=12, threshold=0.002, skip_recent=1)
    led = with_periods(against_benchmark(with_market(bars, REAL).join(target, ["ticker", "date"]), REAL), ("ticker", "account"))
    one = lambda a: led.filter(F.col("account") == a)
    return b.pair_returns(one("selected"), one("benchmark"), KEYS)


PAIRS = (v.SQL_WEEKLY, f"s as (select *, 'selected' as account, {TS} as target from weekly union all select *, 'benchmark', 1e0 from weekly)", ledger_sql("s", keys="ticker,account", **REAL_SQL),
         periods_sql("(select *, 1 as one from led where account='selected')", "pa"), periods_sql("(select *, 1 as one from led where account='benchmark')", "pb"),
         "prs as materialized (select a.ticker, a.period, a.date, a.ret as x, b.ret as y, row_number() over (partition by a.ticker,a.period order by a.date)-1 as i, count(*) over (partition by a.ticker,a.period) as n from pa a join pb b using (ticker,date))")
BOOT = ("sz as (select distinct ticker, period, n, cast(ceil(n/10.0) as bigint) as blocks from prs where n>=60)",
        "drw as (select ticker, period, n, r_.r as resample, b_.b as block, cast('0x'||substr(md5('7:'||r_.r||':'||b_.b),1,8) as bigint)%n as start from sz, (select unnest(range(0,400)) as r) r_, lateral (select unnest(range(0,blocks)) as b) b_)",
        "ix as (select ticker, period, resample, (start+o.o)%n as i from drw, (select unnest(range(0,10)) as o) o where block*10+o.o<n)",
        """rs as materialized (select ticker, period, resample, avg(x)*252 as m, case when stddev_samp(x)>1e-12 then avg(x)*252/(stddev_samp(x)*sqrt(252.0)) end as s, avg(y)*252 as bm,
 case when stddev_samp(y)>1e-12 then avg(y)*252/(stddev_samp(y)*sqrt(252.0)) end as bs, avg(x-y)*252 as ex from ix join prs using (ticker,period,i) group by 1,2,3)""")


@query("bst_resamples", ctes(*PAIRS, *BOOT) + f"select ticker, period, cast(resample as integer) as resample, {r('m')} as strategy_annualized_mean, {r('s')} as strategy_sharpe, {r('bm')} as benchmark_annualized_mean, {r('bs')} as benchmark_sharpe, {r('ex')} as annualized_mean_excess from rs")
def _(t):
    return rounded(b.resample_statistics(paired(t), KEYS, OPTS))


_STAT = (("strategy_annualized_mean", "m", "avg(x)*252", "x"), ("strategy_sharpe", "s", "avg(x)*252/(stddev_samp(x)*sqrt(252.0))", "x"), ("benchmark_annualized_mean", "bm", "avg(y)*252", "y"),
         ("benchmark_sharpe", "bs", "avg(y)*252/(stddev_samp(y)*sqrt(252.0))", "y"), ("annualized_mean_excess", "ex", "avg(x-y)*252", "x-y"))
FULL = "full_ as materialized (" + " union all ".join(
    f"""select p.ticker, p.period, p.n as n_observations, cast(60 as integer) as required, '{name}' as statistic, p.est as estimate, case when q.v=400 and p.n>=60 and p.sd>1e-12 then q.lo end as ci_low, case when q.v=400 and p.n>=60 and p.sd>1e-12 then q.hi end as ci_high,
 coalesce(q.v,0) as valid_resamples, case when p.n<60 then 'insufficient_data' when p.sd<=1e-12 then 'zero_variance' when q.v<>400 then 'degenerate_resamples' else 'ok' end as status
 from (select ticker, period, count(*) as n, case when stddev_samp({x})>1e-12 or '{c}' not in ('s','bs') then {est} end as est, stddev_samp({x}) as sd from prs group by 1,2) p
 left join (select ticker, period, count({c}) as v, quantile_cont({c},0.025) as lo, quantile_cont({c},0.975) as hi from rs group by 1,2) q using (ticker,period)""" for name, c, est, x in _STAT) + ")"


@query("bst_intervals", ctes(*PAIRS, *BOOT, FULL) + f"select ticker, period, n_observations, required, statistic, {r('estimate')} as estimate, {r('ci_low')} as ci_low, {r('ci_high')} as ci_high, valid_resamples, status from full_")
def _(t):
    return rounded(b.bootstrap(paired(t), KEYS, OPTS))


@query("bst_status", ctes(*PAIRS, *BOOT, FULL) + "select ticker, period, case when bool_and(status='ok') then 'ok' when bool_or(status='ok') then 'partial' else 'unavailable' end as status from full_ group by 1,2")
def _(t):
    return b.overall_status(b.bootstrap(paired(t), KEYS, OPTS), KEYS)


@query("bst_generator_intervals")
def _(t):
    """Draws from the seeded generator stream (not expressible in SQL; tested against a direct resampling)."""
    from dataclasses import replace
    return rounded(b.bootstrap(paired(t), KEYS, replace(OPTS, draws="pcg64")))


_PCT = "case when statistic like '%mean%' then {0}*100 else {0} end"
_U = "case when statistic like '%mean%' then '%' else '' end"


@query("rep_bootstrap_table", ctes(*PAIRS, *BOOT, FULL) + f"""select ticker, period, statistic, case when estimate is null then '—' else format('{{:.2f}}',{_PCT.format('estimate')})||{_U} end as estimate, ci_low is not null as estimated, status from full_""")
def _(t):
    tab = reports.interval_table(b.bootstrap(paired(t), KEYS, OPTS), KEYS, digits=2)
    return tab.select("ticker", "period", "statistic", "estimate", (F.col("interval") != "Not estimated").alias("estimated"), "status")
