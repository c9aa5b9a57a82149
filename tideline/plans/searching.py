"""Grid search, ranking with multiple-testing corrections, halving and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.normal import sql_normal_cdf, sql_normal_quantile
from ..operators import selection as sel
from ..operators.ledger import LedgerOptions
from ..operators.robustness import neighbour_scores, robustness
from ..operators import reports
from ..operators.search import development_bars, evaluate_grid, frozen_metrics, run_search, stage_bars, successive_halving
from ..operators.splits import halving_resources
from ..session import cut_lineage
from . import views as v
from .registry import ctes, ewm, full, over, query, r, ret, rounded
from .sqlparts import RETURN_COLS, ledger_sql, metrics_sql, periods_sql

OPTS = LedgerOptions(cost_bps=1.0, slippage_bps=0.5, spread_bps=2.0, execution_lag=1)
GRIDS = {
    "ma_cross": {"fast": [1, 3, 5], "slow": [10, 20], "long_short": [True, False], "ma_type": ["sma"]},
    "tsmom": {"lookback": [3, 10, 21], "threshold": [0.0, 0.005], "long_short": [True, False], "skip_recent": [0, 2]},
}
SMOOTH = [0, 3]


def dev_sql(src: str = "weekly") -> tuple[str, ...]:
    """Development rows: split on all bars, test rows removed."""
    return (periods_sql(src, "dv0", folds=4), "dev as materialized (select * exclude (rn_,n_,s1_,s2_) from dv0 where period in ('train','val'))")


def candidates_sql(src: str = "dev") -> tuple[str, ...]:
    """Unsmoothed targets of both grids on every bar (``cand`` names ticker, strategy, parameters without smoothing)."""
    parts = []
    for f in (1, 3, 5):
        for s in (10, 20):
            gap = f"({full('avg', 'close', f)}-{full('avg', 'close', s)})"
            for ls in ("true", "false"):
                down = f"when {gap}<0 then -1e0" if ls == "true" else ""
                parts.append(f"select *, 'ma_cross' as strategy, '{{\"fast\":{f},\"long_short\":{ls},\"ma_type\":\"sma\",\"signal_smooth\":@,\"slow\":{s}}}' as tpl, case {down} when {gap}>0 then 1e0 else 0e0 end as base from {src}")
    for lb in (3, 10, 21):
        for thr in ("0.0", "0.005"):
            for ls in ("true", "false"):
                for skip in (0, 2):
                    x = ret("close", lb, skip)
                    down = f"when {x}<-{thr} then -1e0" if ls == "true" else ""
                    parts.append(f"select *, 'tsmom' as strategy, '{{\"long_short\":{ls},\"lookback\":{lb},\"signal_smooth\":@,\"skip_recent\":{skip},\"threshold\":{thr}}}' as tpl, case {down} when {x}>{thr} then 1e0 else 0e0 end as base from {src}")
    return (
        "c0 as materialized (select *, row_number() over (partition by ticker,strategy,tpl order by date)-1 as rn from (" + " union all ".join(parts) + "))",
        ewm("c1", "c0", [("base", k.span_alpha(3), "sm3")], keys=("ticker", "strategy", "tpl")),
        """c2 as materialized (select c0.*, replace(tpl,'@','0') as params, base as target from c0 union all
 select c0.*, replace(tpl,'@','3'), sm3 from c0 join c1 using (ticker,strategy,tpl,rn))""",
    )


def results_sql(src: str = "dev") -> tuple[str, ...]:
    """CTE ``res``: one row per ticker and candidate with train/val metrics and fold Sharpes."""
    keys = "ticker,strategy,params"
    fold = ", ".join(f"max(case when fold={i} then s end) as fold{i}" for i in range(1, 5))
    return (
        *candidates_sql(src), ledger_sql("c2", keys=keys, lag=1, k="0.00025"), metrics_sql("led", keys=keys + ",period"),
        f"fs as (select {keys}, fold, case when count(*)<2 or stddev_samp(ret)<1e-10 or avg(abs(held))<=1e-12 then -99.0 else round_even(avg(ret)*252.0/(stddev_samp(ret)*sqrt(252.0)+1e-10),4)+0.0 end as s from led where fold is not null group by all)",
        f"fw as (select {keys}, {fold} from fs group by all)",
        f"pm as (select *, case when undefined_ then -99.0 else sharpe0 end as sharpe from met)",
        f"""res as materialized (select {keys}, a.sharpe as val_sharpe, a.n_observations as val_n, a.trade_count as val_trades, a.exposure as val_exposure, a.skew as val_skew, a.kurtosis as val_kurt, a.cagr as val_cagr,
 a.max_drawdown as val_mdd, b.sharpe as train_sharpe, b.total_return as train_total, fold1, fold2, fold3, fold4 from pm a join pm b using ({keys}) left join fw using ({keys}) where a.period='val' and b.period='train')""",
    )


def results(t, reused: bool = True):
    """Results of both grids; written once when the query reads them more than once."""
    bars = v.weekly_bars(t)
    out = run_search(bars, ["ma_cross", "tsmom"], OPTS, GRIDS, smooth=SMOOTH).withColumn("ann", F.lit(252.0))
    return cut_lineage(out) if reused else out


_FOLDS = "fold1, fold2, fold3, fold4"


@query("sea_grid_results", ctes(v.SQL_WEEKLY, *dev_sql(), *results_sql(), recursive=True)
       + f"""select ticker, strategy, params, val_sharpe, val_n as val_n_observations, val_trades as val_trade_count, {r('val_exposure')} as val_exposure, val_skew, val_kurt as val_kurtosis, {r('case when val_cagr>-1 then ln(1+val_cagr) end', 4)} as val_log_cagr, val_mdd as val_max_drawdown,
 train_sharpe, {r('case when train_total>-1 then ln(1+train_total) end', 4)} as train_log_total, {_FOLDS} from res""")
def _(t):
    res = results(t, reused=False)
    # compounded growth spans many orders of magnitude, so it is reported as a logarithm
    log_growth = lambda c: F.when(F.col(c) > -1, F.log1p(c))
    folds = [F.get("val_fold_sharpes", F.lit(i)).alias(f"fold{i + 1}") for i in range(4)]
    return rounded(res.select("ticker", "strategy", "params", "val_sharpe", "val_n_observations", "val_trade_count", "val_exposure", "val_skew", "val_kurtosis",
                              log_growth("val_cagr").alias("val_log_cagr"), "val_max_drawdown", "train_sharpe",
                              log_growth("train_total_return").alias("train_log_total"), *folds), 6, val_log_cagr=4, train_log_total=4)


@query("sea_resume", ctes(v.SQL_WEEKLY, *dev_sql(), *results_sql(), recursive=True) + "select ticker, strategy, params, val_sharpe from res where not (strategy='ma_cross' and ticker<'N') and not (strategy='tsmom' and ticker>='R')")
def _(t):
    from ..operators.search import candidate_table
    bars = v.weekly_bars(t)
    a = candidate_table(bars, "ma_cross", GRIDS["ma_cross"], SMOOTH).filter("ticker < 'N'")
    b = candidate_table(bars, "tsmom", GRIDS["tsmom"], SMOOTH).filter("ticker >= 'R'")
    out = run_search(bars, ["ma_cross", "tsmom"], OPTS, GRIDS, smooth=SMOOTH, done=a.unionByName(b))
    return out.select("ticker", "strategy", "params", "val_sharpe")


@query("sea_full_grid_tsmom")
def _(t):
    """The whole 11,760-candidate momentum grid on every ticker: top ten per ticker by deflated Sharpe probability."""
    res = cut_lineage(run_search(v.weekly_bars(t), ["tsmom"], OPTS).withColumn("ann", F.lit(252.0)))
    best = sel.top(sel.diagnose(res), 10)
    return rounded(best.select("ticker", "rank", "params", "val_sharpe", "deflated_sharpe", "hurdle", "trials"))


# --- selection --------------------------------------------------------------------------------------------------------

_N = "cast(trials as double)"
_Z = f"((1-0.5772156649015329)*{sql_normal_quantile('(1-1/n_)')}+0.5772156649015329*{sql_normal_quantile('(1-1/(n_*2.718281828459045))')})"
_S = "(val_sharpe/sqrt(252.0))"
_VAR = f"greatest(1-val_skew*{_S}+(val_kurt+2)/4*{_S}*{_S},1e-12)"
SEL = (
    "st0 as (select ticker, count(*) as total, count(*) filter (where val_sharpe>-99) as trials, coalesce(stddev_samp(val_sharpe) filter (where val_sharpe>-99),0) as sharpe_std from res group by 1)",
    "st1 as (select *, cast(trials as double) as n_ from st0)",
    f"st as materialized (select *, case when trials>1 and sharpe_std>0 then sharpe_std*{_Z} else 0 end as hurdle from st1)",
    f"""dg0 as (select res.*, trials, sharpe_std, hurdle, ({_S}-hurdle/sqrt(252.0))*sqrt(val_n-1)/sqrt({_VAR}) as z_, sqrt({_VAR}/(val_n-1))*sqrt(252.0) as se_,
 list_filter([fold1,fold2,fold3,fold4], lambda x: x>-99) as fl from res join st using (ticker) where val_sharpe>-99 and val_n>=60 and val_trades>=1 and val_exposure>=0.01)""",
    f"""dg as materialized (select *, {sql_normal_cdf('z_')} as deflated_sharpe, val_sharpe-1.959963984540054*se_ as sharpe_low, val_sharpe+1.959963984540054*se_ as sharpe_high,
 list_avg(fl) as fold_mean, case when len(fl)>1 then list_stddev_samp(fl) else 0 end as fold_std, list_min(fl) as fold_worst, len(fl) as fold_count from dg0)""",
)


def sel_sql(tail: str, *more: str) -> str:
    return ctes(v.SQL_WEEKLY, *dev_sql(), *results_sql(), *SEL, *more, recursive=True) + tail


@query("sel_dispersion", sel_sql(f"select ticker, total, cast(0 as bigint) as errors, trials, {r('sharpe_std')} as sharpe_std from st"))
def _(t):
    return rounded(sel.dispersion(results(t, reused=False)))


_DG = f"ticker, strategy, params, trials, {r('hurdle')} as hurdle, {r('deflated_sharpe')} as deflated_sharpe, {r('sharpe_low')} as sharpe_low, {r('sharpe_high')} as sharpe_high, {r('fold_mean')} as fold_mean, {r('fold_std')} as fold_std, fold_worst, cast(fold_count as integer) as fold_count"
_DGC = ("ticker", "strategy", "params", "trials", "hurdle", "deflated_sharpe", "sharpe_low", "sharpe_high", "fold_mean", "fold_std", "fold_worst", "fold_count")


@query("sel_diagnostics", sel_sql(f"select {_DG} from dg"))
def _(t):
    return rounded(sel.diagnose(results(t)).select(*_DGC))


@query("sel_trial_override", sel_sql(f"select ticker, {r('h')} as hurdle, count(*) as eligible from (select dg.ticker, (case when dg.ticker<'N' then 2.5*{_Z.replace('n_', 'm_')} else hurdle end) as h from (select *, 5000e0 as m_ from dg) dg) group by 1,2"))
def _(t):
    res = results(t)
    over_ = res.filter("ticker < 'N'").groupBy("ticker").agg(F.lit(5000).cast("bigint").alias("trials"), F.lit(2.5).alias("sharpe_std"))
    return rounded(sel.diagnose(res, overrides=over_).groupBy("ticker", "hurdle").agg(F.count(F.lit(1)).alias("eligible")))


@query("sel_top", sel_sql(f"select ticker, strategy, params, cast(k as integer) as rank, {r('deflated_sharpe')} as deflated_sharpe, val_sharpe from (select *, row_number() over (partition by ticker order by deflated_sharpe desc, val_sharpe desc, strategy, params) as k from dg) where k<=5"))
def _(t):
    return rounded(sel.top(sel.diagnose(results(t)), 5).select("ticker", "strategy", "params", "rank", "deflated_sharpe", "val_sharpe"))


_SPLITS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
_PBO = ("sc as materialized (" + " union all ".join(
    f"select ticker,strategy,params,{i} as split,(0.0+fold{a + 1}+fold{b + 1})/2 as inn,(0.0+{'+'.join(f'fold{c + 1}' for c in range(4) if c not in (a, b))})/2 as outt from dg where fold_count=4" for i, (a, b) in enumerate(_SPLITS)) + ")",
    "pk as (select * from (select *, row_number() over (partition by ticker,split order by inn desc, strategy, params) as k from sc) where k=1)",
    "rk as (select sc.ticker, sc.split, count(*) as n, max(sc.outt)-min(sc.outt) as rg, (count(*) filter (where sc.outt<pk.outt)+(count(*) filter (where sc.outt=pk.outt)+1)/2.0)/(count(*)+1) as pc from sc join pk using (ticker,split) group by 1,2)")


@query("sel_overfitting_probability", sel_sql(f"select ticker, {r('avg(case when ln(pc/(1-pc))<=0 then 1.0 else 0.0 end)')} as pbo, count(*) as combinations, max(n) as candidates from rk where rg>1e-15 group by 1", *_PBO))
def _(t):
    return rounded(sel.overfitting_probability(sel.diagnose(results(t)), 4))


_WF = ("sc as materialized (" + " union all ".join(
    f"select ticker,strategy,params,{f + 1} as outer_fold,(0.0+{'+'.join(f'fold{c + 1}' for c in range(f))})/{f} as inn,fold{f + 1} as outt from dg where fold_count=4" for f in (1, 2, 3)) + ")",
    "pk as materialized (select * from (select *, row_number() over (partition by ticker,outer_fold order by inn desc, strategy, params) as k, count(*) over (partition by ticker,outer_fold) as n from sc) where k=1)")


@query("sel_walk_forward_replay", sel_sql(f"select ticker, outer_fold, n as candidates, strategy, params, {r('outt')} as outer_score, {r('inn')} as inner_score from pk", *_WF))
def _(t):
    return rounded(sel.walk_forward_replay(sel.diagnose(results(t)), 4))


@query("sel_walk_forward_summary", sel_sql(f"select ticker, {r('avg(outt)')} as mean_outer_sharpe, {r('min(outt)')} as worst_outer_sharpe, {r('avg(case when outt>0 then 1.0 else 0.0 end)')} as positive_outer_fraction from pk group by 1", *_WF))
def _(t):
    return rounded(sel.replay_summary(sel.walk_forward_replay(sel.diagnose(results(t)), 4)))


_STAGE = "st9 as materialized (select *, case when val_exposure<=1e-12 then cast('-inf' as double) else val_sharpe end as score from res)"
_SURV = "sv as materialized (select *, row_number() over (partition by ticker,strategy order by score desc, params)<=greatest(1,ceil(count(*) over (partition by ticker,strategy)/3.0)) as advanced from st9)"


@query("sel_stage_survivors", ctes(v.SQL_WEEKLY, *dev_sql(), *results_sql(), _STAGE, _SURV, recursive=True) + "select ticker, strategy, params, score, advanced from sv")
def _(t):
    return sel.survivors(results(t, reused=False), 3).select("ticker", "strategy", "params", "score", "advanced")


@query("sel_stage_summary", ctes(v.SQL_WEEKLY, *dev_sql(), *results_sql(), _STAGE, _SURV, recursive=True)
       + "select cast(0 as integer) as stage, strategy, count(*) as candidates, count(*) filter (where advanced) as advanced_count, cast(0 as bigint) as errors, max(score) filter (where isfinite(score)) as best_score from sv group by strategy union all select 0, null, count(*), count(*) filter (where advanced), 0, max(score) filter (where isfinite(score)) from sv union all select null, null, count(*), count(*) filter (where advanced), 0, max(score) filter (where isfinite(score)) from sv")
def _(t):
    return sel.stage_summary(sel.survivors(results(t, reused=False), 3).withColumn("stage", F.lit(0)))


_STG = ("vtot as (select ticker, count(*) as total from dev where period='val' group by 1)",
        "dev0 as materialized (select * exclude (fold, vr, total), case when period='val' then ntile(4) over (partition by ticker,period order by date) end as fold from (select dev.*, total, row_number() over (partition by ticker,period order by date) as vr from dev join vtot using (ticker)) where period='train' or vr<=greatest(2,ceil(total/9.0)))")


@query("sel_halving_first_stage", ctes(v.SQL_WEEKLY, *dev_sql(), *_STG, *results_sql("dev0"), _STAGE, _SURV, recursive=True) + "select ticker, strategy, params, val_n as val_n_observations, score, advanced from sv")
def _(t):
    dev = development_bars(v.weekly_bars(t), OPTS)
    totals = dev.filter("period = 'val'").groupBy("ticker").agg(F.count(F.lit(1)).alias("total"))
    rows = stage_bars(dev, halving_resources(totals, "total"), 0)
    res = None
    for name in ("ma_cross", "tsmom"):
        part = evaluate_grid(rows, name, OPTS, GRIDS[name], SMOOTH)
        res = part if res is None else res.unionByName(part)
    return sel.survivors(res, 3).select("ticker", "strategy", "params", "val_n_observations", "score", "advanced")


@query("sel_successive_halving")
def _(t):
    """All three stages; every stage equals the one-stage query on its own prefix (tested)."""
    out = successive_halving(v.weekly_bars(t), ["ma_cross", "tsmom"], OPTS, GRIDS, smooth=SMOOTH)
    return out.select("stage", "ticker", "strategy", "params", "resource_bars", "score", "advanced")


# --- robustness -------------------------------------------------------------------------------------------------------

_NB = [(3, 20, True), (2, 20, False), (4, 20, False), (3, 16, False), (3, 24, False)]
_NBSQL = "c2 as materialized (" + " union all ".join(
    f"select *, '{f}/{s}' as cand, {str(b).lower()} as baseline, case when {full('avg', 'close', f)}-{full('avg', 'close', s)}<0 then -1e0 when {full('avg', 'close', f)}-{full('avg', 'close', s)}>0 then 1e0 else 0e0 end as target from dev" for f, s, b in _NB) + ")"
_NB1 = "c3 as materialized (select *, row_number() over (partition by ticker,cand order by date)-1 as rn from c2)"
_NBALL = "c4 as materialized (select * exclude (rn) from c3 union all select c3.* exclude (rn) replace (cand||'s' as cand, false as baseline, sm as target) from c3 join cs using (ticker,cand,rn) where c3.baseline)"


@query("rob_neighbours", ctes(v.SQL_WEEKLY, *dev_sql(), _NBSQL, _NB1, ewm("cs", "c3", [("target", 1.0, "sm")], keys=("ticker", "cand")), _NBALL, ledger_sql("c4", keys="ticker,cand,baseline", lag=1, k="0.00025"), metrics_sql("led", keys="ticker,cand,baseline,period"),
    "nb as materialized (select ticker, baseline, case when undefined_ then -99.0 else sharpe0 end as s from met where period='val')", "bs as (select ticker, s as base from nb where baseline)",
    "g0 as (select ticker, base, count(*) as tried, count(*) filter (where s>-99) as n_neighbours, avg(s) filter (where s>-99) as mean, median(s) filter (where s>-99) as median, stddev_pop(s) filter (where s>-99) as std, min(s) filter (where s>-99) as min, max(s) filter (where s>-99) as max, avg(case when s>-99 then (s<base*0.5)::int end) as pct_degrade, avg(case when s>-99 then (s>0)::int end) as pct_positive from nb join bs using (ticker) where not baseline group by 1,2)",
    "g1 as (select *, case when tried<4 or n_neighbours=0 then 'N/A' when base>0 and median>=0.8*base and pct_degrade<0.15 then 'A' when base>0 and median>=0.6*base and pct_degrade<0.35 then 'B' when median>=0.4*greatest(base,0) then 'C' else 'D' end as grade from g0)", recursive=True)
    + f"""select ticker, 'ma_cross' as strategy, base, tried, n_neighbours, {r('mean')} as mean, {r('median')} as median, {r('std')} as std, min, max, {r('pct_degrade')} as pct_degrade, {r('pct_positive')} as pct_positive, grade,
 case when grade<>'N/A' then coalesce(base>0 and (median<0.5*base or pct_degrade>0.4),false) end as isolated_peak, case grade when 'N/A' then 'Skipped' when 'A' then 'Robust' when 'B' then 'Relatively stable' when 'C' then 'Fragile' else 'Locally unstable' end as verdict from g1""")
def _(t):
    dev = development_bars(v.weekly_bars(t), OPTS)
    return rounded(robustness(neighbour_scores(dev, "ma_cross", {"fast": 3, "slow": 20}, OPTS)))


# --- the frozen winner on the sealed window ---------------------------------------------------------------------------

def _renamed(parts, old_new):
    out = []
    for text in parts:
        for old, new in old_new:
            text = text.replace(old, new)
        out.append(text)
    return tuple(out)


_ALLC = _renamed(candidates_sql("dv0"), (("c0", "y0"), ("c1", "y1"), ("c2", "y2"), ("sm3", "ysm")))
FROZEN = ("win as materialized (select ticker, strategy, params from (select *, row_number() over (partition by ticker order by deflated_sharpe desc, val_sharpe desc, strategy, params) as k from dg) where k=1)",
          *_ALLC, """acc as materialized (select y2.* exclude (strategy,params), 'selected' as account, y2.strategy, y2.params from y2 join win using (ticker,strategy,params)
 union all select y2.* exclude (strategy,params) replace (1e0 as target), 'benchmark', 'buy_and_hold', '{}' from y2 join win using (ticker,strategy,params))""",
          ledger_sql("acc", name="ldz", keys="ticker,account,strategy,params", lag=1, k="0.00025"), metrics_sql("ldz", name="mtz", keys="ticker,account,strategy,params,period"))
_FCOLS = f"account, strategy, params, period, case when undefined_ then -99.0 else sharpe0 end as sharpe, {RETURN_COLS}, n_observations, trade_count, {r('exposure')} as exposure, {r('turnover', 4)} as turnover"


def frozen(t):
    res = results(t)
    return frozen_metrics(v.weekly_bars(t), sel.top(sel.diagnose(res), 1), OPTS, GRIDS, SMOOTH)


@query("sel_frozen_test_metrics", sel_sql(f"select ticker, {_FCOLS} from mtz where period in ('val','test')", *FROZEN))
def _(t):
    cols = RETURN_COLS.replace(" ", "").split(",")
    return rounded(frozen(t).select("ticker", "account", "strategy", "params", "period", "sharpe", *cols, "n_observations", "trade_count", "exposure", "turnover"), 6, turnover=4)


_RL = (("sharpe", "Sharpe"), ("total_return", "Total return"), ("max_drawdown", "Maximum drawdown"), ("win_rate", "Win rate"), ("trade_count", "Trades"))
_RSQL = " union all ".join(
    f"select ticker, '{lab}' as label, max(v) filter (where account='selected' and period='val') as validation, max(v) filter (where account='selected' and period='test') as test, max(v) filter (where account='benchmark' and period='test') as benchmark from (select *, cast({'case when undefined_ then -99.0 else sharpe0 end' if c == 'sharpe' else c} as double)+0.0 as v from mtz) group by ticker" for c, lab in _RL)


@query("rep_search_metrics", sel_sql(_RSQL, *FROZEN))
def _(t):
    m = frozen(t).withColumn("column", F.concat_ws("_", "account", "period"))
    return reports.side_by_side(m, "column", {"selected_val": "validation", "selected_test": "test", "benchmark_test": "benchmark"}, dict(_RL), ("ticker",))


@query("snk_top_table", sel_sql(f"select ticker, strategy, params, cast(k as integer) as rank, {r('deflated_sharpe')} as deflated_sharpe, val_sharpe, train_sharpe, {r('hurdle')} as hurdle from (select *, row_number() over (partition by ticker order by deflated_sharpe desc, val_sharpe desc, strategy, params) as k from dg) where k<=3"))
def _(t):
    flat = reports.top_table(sel.top(sel.diagnose(results(t)), 3))
    return rounded(flat.select("ticker", "strategy", "params", "rank", "deflated_sharpe", "val_sharpe", "train_sharpe", "hurdle"))


@query("snk_summary_record", sel_sql("select ticker, trials, eligible, best from (select ticker, any_value(trials) as trials, count(*) as eligible, max(val_sharpe) as best from dg group by 1)"))
def _(t):
    from ..sources.sinks import jsonable
    d = sel.diagnose(results(t))
    return jsonable(d.groupBy("ticker").agg(F.max("trials").alias("trials"), F.count(F.lit(1)).alias("eligible"), F.max("val_sharpe").alias("best")))
