"""Cross-sectional portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as p
from ..operators import reports
from . import views as v
from .registry import ctes, full, lag, over, query, r, ret, rounded

MOM = p.MomentumOptions(lookback=13, skip_recent=1, top_k=2, rebalance="monthly", absolute_threshold=0.0, max_weight=0.45)
EXE = p.ExecutionOptions(cost_bps=20, slippage_bps=5, spread_bps=10, cash_rate=0.03)
CAPPED = p.ExecutionOptions(cost_bps=20, slippage_bps=5, spread_bps=10, cash_rate=0.03, max_turnover=0.6)

#: membership of the weekly tickers: a busy week adds, a quiet week removes
SQL_MEMBERS = f"""mem as materialized (select ticker, date, coalesce(last_value(a ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row), ticker<'N') as eligible
 from (select ticker, date, case when volume>1.15*m then true when volume<0.85*m then false end as a from (select *, avg(volume) over (partition by ticker) as m from weekly)))"""


def _prices(t):
    return p.with_book(v.aligned_weekly_bars(t).select("ticker", "date", "close", "volume"))


def _members(t):
    from pyspark.sql import Window

    from ..operators.membership import eligibility
    w = v.aligned_weekly_bars(t).withColumn("m", F.avg("volume").over(Window.partitionBy("ticker")))
    ev = w.select("ticker", F.col("date").alias("effective_on"), F.when(F.col("volume") > 1.15 * F.col("m"), "add").when(F.col("volume") < 0.85 * F.col("m"), "remove").alias("action")).filter("action is not null")
    opening = w.select("ticker").distinct().filter("ticker < 'N'")
    return eligibility(w.select("ticker", "date"), ev, opening)


SC = f"sc as materialized (select ticker, date, {lag('close', 1)}/{lag('close', 13)}-1 as score, row_number() over (partition by ticker order by date)-1 as n from weekly)"


def flags_sql(unit: str | None, changed: bool = False) -> str:
    f = "true" if unit is None else f"coalesce(date_trunc('{unit}',date)<>lag(date_trunc('{unit}',date)) over (order by date),true)"
    ch = " or coalesce(c,false)" if changed else ""
    j = " left join (select date, bool_or(ch) as c from (select date, coalesce(eligible<>lag(eligible) over (partition by ticker order by date),true) as ch from mem) group by 1) using (date)" if changed else ""
    return f"fl as materialized (select date, n, case when n<13 then false when n=13 then true else ({f}){ch} end as scheduled from (select date, row_number() over (order by date)-1 as n from (select distinct date from weekly)){j})"


def targets_sql(member: bool = False) -> str:
    s = "case when eligible then score end" if member else "score"
    j = "join mem using (ticker,date)" if member else ""
    return (f"tg as materialized (select date, ticker, case when s>0 and k<=2 then 45e-2 else 0e0 end as weight, s as score from (select *, row_number() over (partition by date order by s desc nulls last, ticker) as k from "
            f"(select sc.date, sc.ticker, {s} as s from sc {j} join fl using (date) where scheduled)))")


@query("pf_scores", ctes(v.SQL_ALIGNED, SC) + f"select 'all' as book, date, ticker, {r('score')} as score from sc")
def _(t):
    return rounded(p.scores(_prices(t), MOM))


@query("pf_scores_members", ctes(v.SQL_ALIGNED, SC, SQL_MEMBERS) + f"select 'all' as book, date, ticker, {r('case when eligible then score end')} as score from sc join mem using (ticker,date)")
def _(t):
    return rounded(p.scores(_prices(t), MOM, _members(t)))


for _unit, _name in ((None, "daily"), ("week", "weekly"), ("month", "monthly")):
    @query(f"pf_signal_dates_{_name}", ctes(v.SQL_ALIGNED, flags_sql(_unit)) + "select 'all' as book, date, cast(n as integer) as _n, scheduled from fl")
    def _(t, name=_name):
        return p.signal_dates(_prices(t), p.MomentumOptions(lookback=13, rebalance=name))


@query("pf_signal_dates_members", ctes(v.SQL_ALIGNED, SQL_MEMBERS, flags_sql("month", True)) + "select 'all' as book, date, cast(n as integer) as _n, scheduled from fl")
def _(t):
    return p.signal_dates(_prices(t), MOM, _members(t))


@query("pf_targets", ctes(v.SQL_ALIGNED, SC, flags_sql("month"), targets_sql()) + f"select 'all' as book, date, ticker, {r('weight')} as weight, {r('score')} as score from tg")
def _(t):
    return rounded(p.momentum_targets(_prices(t), MOM))


@query("pf_targets_members", ctes(v.SQL_ALIGNED, SC, SQL_MEMBERS, flags_sql("month", True), targets_sql(True)) + f"select 'all' as book, date, ticker, {r('weight')} as weight, {r('score')} as score from tg")
def _(t):
    return rounded(p.momentum_targets(_prices(t), MOM, _members(t)))


BT = "bt as materialized (select w.date, w.ticker, least(1e0/count(*) over (partition by w.date),45e-2) as weight from weekly w where w.date=(select min(date) from fl where scheduled))"
BTM = "bt as materialized (select date, ticker, case when eligible then least(1e0/sum(eligible::int) over (partition by date),45e-2) else 0e0 end as weight from mem join fl using (date) where scheduled)"


@query("pf_benchmark_targets", ctes(v.SQL_ALIGNED, flags_sql("month"), BT) + f"select 'all' as book, date, ticker, {r('weight')} as weight from bt")
def _(t):
    return rounded(p.benchmark_targets(_prices(t), MOM))


@query("pf_benchmark_targets_members", ctes(v.SQL_ALIGNED, SQL_MEMBERS, flags_sql("month", True), BTM) + f"select 'all' as book, date, ticker, {r('weight')} as weight from bt")
def _(t):
    return rounded(p.benchmark_targets(_prices(t), MOM, _members(t)))


def book_sql(tg: str, name: str = "bk", cap: float | None = None, k: float = 0.003, cash: float = 0.03, rows: str = "weekly") -> tuple[str, ...]:
    """Unit-holding account walked date by date; the post-cost value is found by fixed-point iteration."""
    idx = "range(1,len(p)+1)"
    frac = "1e0" if cap is None else f"case when rt>{cap} then {cap}/rt else 1e0 end"
    return (
        f"{name}p as (select date, list(close order by ticker) as p, list(ticker order by ticker) as tk from {rows} group by date)",
        f"{name}d as (select date, p, tk, row_number() over (order by date)-1 as rn, coalesce(date_diff('day',lag(date) over (order by date),date),0) as days from {name}p)",
        f"{name}t as (select d.rn+1 as rn, list(cast(t.weight as double) order by t.ticker) as w from {tg} t join {name}d d using (date) group by d.rn)",
        f"{name}s as materialized (select d.*, t.w from {name}d d left join {name}t t using (rn))",
        f"""{name} as (select date, rn, p, tk, w, 1e6 as cash, list_transform(p, lambda x: 0e0) as units, 1e6 as nav, 1e6 as pre, 0e0 as interest, 0e0 as pnl, list_transform(p, lambda x: 0e0) as req, list_transform(p, lambda x: 0e0) as tr, 0e0 as frac from {name}s where rn=0
 union all select date, rn, p, tk, w, cash2, case when ex then list_transform({idx}, lambda j: (vv[j]+tr[j])/p[j]) else u0 end, case when ex then cash2+list_sum(vv)+list_sum(tr) else pre end, pre, interest, pnl, req, tr, frac from
 (select *, case when ex then pre-{k}*list_sum(list_transform(tr, lambda x: abs(x)))-list_sum(vv)-list_sum(tr) else c1 end as cash2 from
 (select *, list_transform(req, lambda x: x*frac) as tr from
 (select *, case when ex then {frac} else 0e0 end as frac from
 (select *, case when ex then list_sum(list_transform(req, lambda x: abs(x)))/pre else 0e0 end as rt from
 (select *, case when ex then list_transform({idx}, lambda j: w[j]*npost-vv[j]) else list_transform(p, lambda x: 0e0) end as req from
 (select *, case when ex then list_reduce(range(1,30), lambda a, i: pre-{k}*list_sum(list_transform({idx}, lambda j: abs(w[j]*a-vv[j]))), pre) end as npost from
 (select s.date, s.rn, s.p, s.tk, s.w, s.w is not null as ex, e.units as u0, e.cash*pow({1 + cash},s.days/365.0) as c1, e.cash*(pow({1 + cash},s.days/365.0)-1) as interest,
   list_transform(range(1,len(s.p)+1), lambda j: e.units[j]*s.p[j]) as vv, e.cash*pow({1 + cash},s.days/365.0)+list_sum(list_transform(range(1,len(s.p)+1), lambda j: e.units[j]*s.p[j])) as pre,
   list_sum(list_transform(range(1,len(s.p)+1), lambda j: e.units[j]*(s.p[j]-e.p[j]))) as pnl from {name} e join {name}s s on s.rn=e.rn+1))))))))""")


def nav_sql(name: str, book: str = "'all'", k: float = 0.003) -> str:
    return f"""select {book} as book, date, {r('nav', 2)} as nav, {r('cash/nav')} as cash_weight, {r('pnl', 2)} as asset_pnl, {r('interest', 2)} as cash_interest, {r('pre', 2)} as pre_trade_nav,
 {r(f'{k}*list_sum(list_transform(tr, lambda x: abs(x)))', 2)} as transaction_cost, {r('list_sum(list_transform(tr, lambda x: abs(x)))/pre')} as turnover, {r('pre/coalesce(lag(nav) over (order by date),1e6)-1')} as gross_return, {r('nav/coalesce(lag(nav) over (order by date),1e6)-1')} as net_return,
 w is not null as rebalance_executed, {r('list_sum(list_transform(req, lambda x: abs(x)))', 2)} as requested_notional, {r('list_sum(list_transform(range(1,len(p)+1), lambda j: abs(req[j]-tr[j])))', 2)} as unfilled_notional, {r('frac')} as fill_fraction from {name}"""


_NAV = ("book", "date", "nav", "cash_weight", "asset_pnl", "cash_interest", "pre_trade_nav", "transaction_cost", "turnover", "gross_return", "net_return",
        "rebalance_executed", "requested_notional", "unfilled_notional", "fill_fraction")


def _nav(df):
    money = {c: 2 for c in ("nav", "asset_pnl", "cash_interest", "pre_trade_nav", "transaction_cost", "requested_notional", "unfilled_notional")}
    return rounded(df.select(*_NAV), 6, **money)


BOOK = (v.SQL_ALIGNED, SC, flags_sql("month"), targets_sql())


@query("pf_book", ctes(*BOOK, *book_sql("tg"), recursive=True) + nav_sql("bk"))
def _(t):
    prices = _prices(t)
    return _nav(p.book(p.momentum_targets(prices, MOM), prices, EXE)[0])


@query("pf_book_legs", ctes(*BOOK, *book_sql("tg"), recursive=True) + f"""select 'all' as book, date, ticker, {r('units*px/nav')} as weight, {r('units', 4)} as units, {r('trade', 2)} as trade, {r('tgt')} as executed_target from
 (select date, nav, unnest(tk) as ticker, unnest(units) as units, unnest(p) as px, unnest(tr) as trade, unnest(coalesce(w, list_transform(p, lambda x: cast(null as double)))) as tgt from bk)""")
def _(t):
    prices = _prices(t)
    legs = p.book(p.momentum_targets(prices, MOM), prices, EXE)[1]
    return rounded(legs.select("book", "date", "ticker", "weight", "units", "trade", "executed_target"), 6, units=4, trade=2)


@query("pf_book_members", ctes(v.SQL_ALIGNED, SC, SQL_MEMBERS, flags_sql("month", True), targets_sql(True), *book_sql("tg"), recursive=True) + nav_sql("bk"))
def _(t):
    prices, mem = _prices(t), _members(t)
    return _nav(p.book(p.momentum_targets(prices, MOM, mem), prices, EXE)[0])


@query("pf_turnover_budget", ctes(*BOOK, *book_sql("tg", cap=0.6), recursive=True) + nav_sql("bk"))
def _(t):
    prices = _prices(t)
    return _nav(p.book(p.momentum_targets(prices, MOM), prices, CAPPED)[0])


def both_books(t, exe=EXE):
    """Strategy and benchmark accounts in one run, keyed by ``book``."""
    prices = _prices(t)
    two = lambda df, name: df.withColumn("book", F.lit(name))
    targets = two(p.momentum_targets(prices, MOM), "strategy").unionByName(two(p.benchmark_targets(prices, MOM), "benchmark"), allowMissingColumns=True)
    quotes = prices.drop("book").withColumn("book", F.explode(F.array(F.lit("strategy"), F.lit("benchmark"))))
    nav, legs = p.book(targets, quotes, exe)
    return targets, nav, legs


BOTH = (*BOOK, BT, *book_sql("tg", "b1"), *book_sql("bt", "b2"), "ab as materialized (select 'strategy' as book, * from b1 union all select 'benchmark', * from b2)",
        f"""navs as materialized (select book, date, nav, nav/1e6 as equity, cash/nav as cw, list_sum(list_transform(tr, lambda x: abs(x))) as notional, list_sum(list_transform(tr, lambda x: abs(x)))/pre as turn, w is not null as ex,
 nav/coalesce(lag(nav) over (partition by book order by date),1e6)-1 as nr, row_number() over (partition by book order by date) as i, greatest(max(nav/1e6) over (partition by book order by date),1) as peak from ab)""")
PM = f"""pm as materialized (select book, count(*) filter (where i>1) as return_intervals, arg_max(nav,date) as final_nav, arg_max(equity,date) as eq, avg(nr) filter (where i>1) as mn, stddev_samp(nr) filter (where i>1) as sd,
 min(equity/peak-1) as max_drawdown, sum(notional)*0.003 as transaction_costs, sum(notional) as traded_notional, sum(turn) as turnover, count(*) filter (where ex) as rebalances, avg(cw) as average_cash_weight from navs group by book)"""


@query("pf_metrics", ctes(*BOTH, PM, recursive=True) + f"""select book, return_intervals, {r('final_nav', 2)} as final_nav, {r('max_drawdown')} as max_drawdown, {r('transaction_costs', 2)} as transaction_costs, {r('traded_notional', 2)} as traded_notional,
 {r('turnover')} as turnover, rebalances, {r('average_cash_weight')} as average_cash_weight, {r('traded_notional', 2)} as requested_notional, 0e0 as unfilled_notional, cast(0 as bigint) as limited_rebalances, {r('sd*sqrt(52.0)')} as volatility,
 {r('eq-1')} as total_return, {r('exp(ln(eq)*52.0/return_intervals)-1')} as cagr, {r('(mn*52.0-0.02)/(sd*sqrt(52.0))')} as sharpe from pm""")
def _(t):
    _, nav, _ = both_books(t)
    money = {c: 2 for c in ("final_nav", "transaction_costs", "traded_notional", "requested_notional")}
    return rounded(p.metrics(nav, 52.0, 0.02), 6, **money)


LAST = """lastw as (select book, unnest(tk) as ticker, unnest(list_transform(range(1,len(p)+1), lambda j: units[j]*p[j]/nav)) as lw, cash/nav as lcw from ab where date=(select max(date) from weekly)),
 lastx as (select book, max(date) as le from navs where ex group by 1),
 tgs as (select 'strategy' as book, date, ticker, weight, score from tg union all select 'benchmark', date, ticker, weight, null from bt),
 lasts as (select book, max(date) as ls from tgs group by 1)"""


@query("pf_summary", ctes(*BOTH, LAST, recursive=True) + f"""select w.book, w.ticker, {r('w.lw')} as latest_weight, {r('w.lcw')} as latest_cash_weight, x.le as last_execution_date, s.ls as last_signal_date, {r('g.weight')} as last_target, {r('g.score')} as last_score
 from lastw w join lastx x using (book) join lasts s using (book) join tgs g on g.book=w.book and g.ticker=w.ticker and g.date=s.ls""")
def _(t):
    targets, nav, legs = both_books(t)
    return rounded(p.summary(nav, legs, targets))


@query("pf_study_boundary", ctes(v.SQL_ALIGNED, "d as (select distinct date from weekly)") + """select 'all' as book, count(*) filter (where date<date '2000-01-03') as development, count(*) filter (where date>=date '2000-01-03') as test, max(date) filter (where date<date '2000-01-03') as anchor,
 case when count(*) filter (where date=date '2000-01-03')=0 then 'test_start is no session' when count(*) filter (where date<date '2000-01-03')<15 then 'too little development history' when count(*) filter (where date>=date '2000-01-03')<2 then 'too few test sessions' end as problem from d""")
def _(t):
    return p.study_boundary(_prices(t), "2000-01-03", 13)


@query("pf_study_test_book", ctes(*BOOK, *book_sql("tg"), "x as (select *, list_sum(list_transform(tr, lambda z: abs(z))) as notional, nav/coalesce(lag(nav) over (order by date),1e6)-1 as nr from bk)", recursive=True)
       + f"""select 'all' as book, date, {r('nav/first_value(nav) over (order by date)')} as equity, {r('case when date=date \'1999-12-27\' then 0 else nr end')} as net_return, {r('case when date=date \'1999-12-27\' then 0 else notional/pre end')} as turnover,
 {r('case when date=date \'1999-12-27\' then nav else pre end', 2)} as pre_trade_nav, w is not null and date<>date '1999-12-27' as rebalance_executed from x where date>=date '1999-12-27'""")
def _(t):
    prices = _prices(t)
    nav, legs = p.book(p.momentum_targets(prices, MOM), prices, EXE)
    nav, _legs = p.rebase(nav, legs, "1999-12-27")
    return rounded(nav.select("book", "date", "equity", "net_return", "turnover", "pre_trade_nav", "rebalance_executed"), 6, pre_trade_nav=2)


@query("pf_development_book", ctes(v.SQL_ALIGNED, "dev as materialized (select * from weekly where date<date '2000-01-03')", SC.replace("from weekly", "from dev"), flags_sql("month").replace("from weekly", "from dev"), targets_sql(), *book_sql("tg", rows="dev"), recursive=True) + nav_sql("bk"))
def _(t):
    prices = _prices(t).filter("date < '2000-01-03'")
    return _nav(p.book(p.momentum_targets(prices, MOM), prices, EXE)[0])


@query("snk_weights_wide", ctes(*BOOK, *book_sql("tg"), recursive=True) + "select date, " + ", ".join(f"{r(f'list_extract(units,{i + 1})*list_extract(p,{i + 1})/nav')} as {a}" for i, a in enumerate(("AF", "AO", "NF", "NO", "RF", "RO"))) + " from bk")
def _(t):
    from ..sources.sinks import wide
    prices = _prices(t)
    legs = p.book(p.momentum_targets(prices, MOM), prices, EXE)[1]
    return rounded(wide(legs, "weight", ["AF", "AO", "NF", "NO", "RF", "RO"]))


_LABELS = (("return_intervals", "Return intervals"), ("final_nav", "Final NAV"), ("total_return", "Total return"), ("cagr", "CAGR"), ("sharpe", "Sharpe"),
           ("volatility", "Volatility"), ("max_drawdown", "Maximum drawdown"), ("turnover", "Turnover"), ("rebalances", "Rebalances"))
_PMX = "pmx as (select *, eq-1 as total_return, exp(ln(eq)*52.0/return_intervals)-1 as cagr, (mn*52.0-0.02)/(sd*sqrt(52.0)) as sharpe, sd*sqrt(52.0) as volatility from pm)"


@query("rep_portfolio_metrics", ctes(*BOTH, PM, _PMX, recursive=True) + " union all ".join(
    f"select '{label}' as label, {r(f'max({c}) filter (where book=' + chr(39) + 'strategy' + chr(39) + ')', 4)} as portfolio, {r(f'max({c}) filter (where book=' + chr(39) + 'benchmark' + chr(39) + ')', 4)} as benchmark from pmx" for c, label in _LABELS))
def _(t):
    _, nav, _ = both_books(t)
    return rounded(reports.side_by_side(p.metrics(nav, 52.0, 0.02), "book", {"strategy": "portfolio", "benchmark": "benchmark"}, dict(_LABELS)), 4)


@query("rep_portfolio_allocations", ctes(*BOTH, LAST, recursive=True) + f"""select w.ticker as asset, {r('w.lw')} as final_weight, {r('g.weight')} as last_target, {r('g.score')} as last_score from lastw w join lasts s using (book) join tgs g on g.book=w.book and g.ticker=w.ticker and g.date=s.ls where w.book='strategy'
 union all select 'Uninvested cash', {r('max(w.lcw)')}, {r('greatest(0,1-sum(g.weight))')}, null from lastw w join lasts s using (book) join tgs g on g.book=w.book and g.ticker=w.ticker and g.date=s.ls where w.book='strategy'""")
def _(t):
    targets, nav, legs = both_books(t)
    return rounded(reports.allocations(p.summary(nav, legs, targets).filter("book = 'strategy'")))
