"""Walk-forward classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear, trees
from ..operators import walkforward as w
from ..operators.features import feature_names
from ..operators.grid import canonical
from ..operators.search import positions, run_search
from ..session import cut_lineage
from . import views as v
from .registry import ctes, query, r, rounded
from .searching import OPTS as SEARCH
from .searching import dev_sql
from .sqlparts import ledger_sql, metrics_sql
from .technical import features_cte

OPTS = w.WalkOptions(train_size=42, step=21, forward=5)
SVM = w.WalkOptions(train_size=42, step=42, forward=5)
NAMES = feature_names()

LAB = (v.SQL_WEEKLY, *features_cte("weekly"),
       f"lab as materialized (select feat.*, (lead(close,5) over (partition by feat.ticker order by feat.date)/close-1>0)::int as label, {' and '.join(f'feat.{n} is not null' for n in NAMES)} as ok from feat join (select ticker,date,close from weekly) using (ticker,date))",
       "ord as (select *, case when ok then sum(ok::int) over (partition by ticker order by rn)-1 end as o from lab)",
       "fld as materialized (select *, case when o>=42 then cast(floor((o-42)/21.0) as bigint) end as fold from ord)",
       "cuts as (select ticker, fold, min(rn)-5 as cut, count(*) as rows from fld where fold is not null group by 1,2)",
       "trn as (select c.ticker, c.fold, c.cut, c.rows, count(l.label) as train_rows, coalesce(sum(l.label),0)::bigint as positives from cuts c left join lab l on l.ticker=c.ticker and l.rn<=c.cut and l.ok and l.label is not null group by all)",
       "fits as materialized (select *, train_rows>=2 and positives>0 and positives<train_rows as fitted from trn)")


def data(t, opts=OPTS):
    return w.labelled(v.weekly_bars(t), opts)


@query("ml_labels", ctes(*LAB, recursive=True) + "select ticker, date, ok as usable, cast(label as integer) as label from lab")
def _(t):
    return data(t).select("ticker", "date", F.col("x").isNotNull().alias("usable"), "label")


@query("ml_folds", ctes(*LAB, recursive=True) + "select ticker, fold, cast(cut as integer) as cut, rows, train_rows, positives, fitted from fits")
def _(t):
    return w.fold_table(data(t), OPTS).select("ticker", "fold", "cut", "rows", "train_rows", "positives", "fitted")


_Z = ", ".join(f"avg({n}) as m_{n}, stddev_pop({n}) as s_{n}" for n in NAMES)
MOM = f"mom as materialized (select c.ticker, c.fold, {_Z} from fits c join lab l on l.ticker=c.ticker and l.rn<=c.cut and l.ok and l.label is not null where c.fitted group by 1,2)"


@query("ml_scaled_features", ctes(*LAB, MOM, recursive=True) + f"select f.ticker, f.date, f.fold, {r('(ret_5-m_ret_5)/s_ret_5')} as z_ret_5, {r('(rsi_14-m_rsi_14)/s_rsi_14')} as z_rsi_14, {r('(range_55-m_range_55)/s_range_55')} as z_range_55 from fld f join mom using (ticker,fold)")
def _(t):
    rows = w.scaled_rows(data(t), OPTS, 55)
    z = lambda n: F.get("z", F.lit(NAMES.index(n))).alias(f"z_{n}")
    return rounded(rows.select("ticker", "date", "fold", z("ret_5"), z("rsi_14"), z("range_55")))


def _ll(c: int) -> str:
    return "+".join(f"(ln(2*pi()*(k{c}.v_{n}/(s_{n}*s_{n})+1e-3))+pow((f.{n}-k{c}.a_{n})/s_{n},2)/(k{c}.v_{n}/(s_{n}*s_{n})+1e-3))" for n in NAMES)


def _cls(c: int) -> str:
    cols = ", ".join(f"avg({n}) as a_{n}, var_pop({n}) as v_{n}" for n in NAMES)
    return f"k{c} as materialized (select c.ticker, c.fold, count(*) as n_, {cols} from fits c join lab l on l.ticker=c.ticker and l.rn<=c.cut and l.ok and l.label={c} where c.fitted group by 1,2)"


@query("ml_naive_bayes", ctes(*LAB, MOM, _cls(0), _cls(1), f"sc as (select f.ticker, f.date, f.fold, ln(k0.n_/(k0.n_+k1.n_))-0.5*({_ll(0)}) as s0, ln(k1.n_/(k0.n_+k1.n_))-0.5*({_ll(1)}) as s1 from fld f join mom using (ticker,fold) join k0 using (ticker,fold) join k1 using (ticker,fold))", recursive=True)
       + f"select ticker, date, fold, {r('s0', 4)} as score0, {r('s1', 4)} as score1, cast(s1>s0 as integer) as pred from sc")
def _(t):
    return rounded(w.naive_bayes(data(t), OPTS, 1e-3), 4)


@query("ml_naive_bayes_positions", ctes(*LAB, MOM, _cls(0), _cls(1), f"sc as (select f.ticker, f.date, ln(k0.n_/(k0.n_+k1.n_))-0.5*({_ll(0)}) as s0, ln(k1.n_/(k0.n_+k1.n_))-0.5*({_ll(1)}) as s1 from fld f join mom using (ticker,fold) join k0 using (ticker,fold) join k1 using (ticker,fold))", recursive=True)
       + "select l.ticker, l.date, case when s1 is null then 0e0 when s1>s0 then 1e0 else -1e0 end as target from lab l left join sc using (ticker,date)")
def _(t):
    d = data(t)
    return w.to_positions(d, w.naive_bayes(d, OPTS, 1e-3))


_ONE = (*LAB, MOM, _cls(0), _cls(1), "ff as (select ticker, min(fold) as fold from fits where fitted group by 1)",
        f"sc as (select f.ticker, f.date, ln(k0.n_/(k0.n_+k1.n_))-0.5*({_ll(0)}) as s0, ln(k1.n_/(k0.n_+k1.n_))-0.5*({_ll(1)}) as s1 from fld f join ff on ff.ticker=f.ticker and f.fold>=ff.fold join mom on mom.ticker=ff.ticker and mom.fold=ff.fold join k0 on k0.ticker=ff.ticker and k0.fold=ff.fold join k1 on k1.ticker=ff.ticker and k1.fold=ff.fold)",
        "pos as materialized (select l.ticker, l.date, case when s1>s0 then 1e0 else 0e0 end as target from lab l left join sc using (ticker,date))")


@query("str_ml_nb", ctes(*_ONE, recursive=True) + "select ticker, date, target*0.5 as target from pos")
def _(t):
    """A classifier by name like any rule: fitted once, long only, half size."""
    return positions(v.weekly_bars(t), "ml_nb", lookback=42, forward=5, var_smoothing=1e-3, retrain=False, long_short=False, position_size=0.5)


_DIST = "+".join(f"pow((f.{n}-g.{n})/s_{n},2)" for n in NAMES)


@query("ml_nearest_neighbours", ctes(*LAB, MOM, f"prs as (select f.ticker, f.date, f.fold, g.label, sqrt({_DIST}) as d from fld f join fits c using (ticker,fold) join mom using (ticker,fold) join lab g on g.ticker=f.ticker and g.rn<=c.cut and g.ok and g.label is not null where c.fitted)",
       "top as (select *, row_number() over (partition by ticker,date order by d) as k from prs)", recursive=True)
       + "select ticker, date, fold, cast(sum(case when label=1 then 1/d else 0 end)>sum(case when label=0 then 1/d else 0 end) as integer) as pred from top where k<=7 group by 1,2,3")
def _(t):
    return w.nearest_neighbours(data(t), OPTS, 7, "distance", 2)


@query("ml_random_forest")
def _(t):
    """All 55 features, a forest per ticker and fold."""
    return trees.random_forest(cut_lineage(data(t)), OPTS, n_estimators=20, max_depth=3)


@query("ml_boosted_trees")
def _(t):
    return trees.boosted_trees(cut_lineage(data(t)), OPTS, n_estimators=5, max_depth=2, learning_rate=0.3, subsample=0.8, colsample_bytree=0.7)


@query("ml_logistic")
def _(t):
    """All 55 features, one l2 model per ticker and fold."""
    return linear.logistic_regression(cut_lineage(data(t)), OPTS, 0.5)


@query("ml_linear_svm")
def _(t):
    return linear.linear_svm(cut_lineage(data(t, SVM)), SVM, 0.1)


# Three features, so that plain gradient descent in SQL gets to the same minimum: its step is the inverse of a bound on the curvature.
THREE = ("ret_5", "vol_21", "range_55")
_W = ("w1", "w2", "w3")
_SC = ", ".join(f"(l.{n}-m.a{i})/m.s{i} as z{i}" for i, n in enumerate(THREE, 1))
LOGIT = (
    v.SQL_WEEKLY, *features_cte("weekly"),
    f"lab as materialized (select feat.*, (lead(close,5) over (partition by feat.ticker order by feat.date)/close-1>0)::int as label, {' and '.join(f'feat.{n} is not null' for n in THREE)} as ok from feat join (select ticker,date,close from weekly) using (ticker,date))",
    *LAB[len(LAB) - 5:],
    f"mo as (select c.ticker, c.fold, c.cut, count(*) as n, {', '.join(f'avg({n}) as a{i}, stddev_pop({n}) as s{i}' for i, n in enumerate(THREE, 1))} from fits c join lab l on l.ticker=c.ticker and l.rn<=c.cut and l.ok and l.label is not null where c.fitted group by 1,2,3)",
    f"tr as materialized (select m.ticker, m.fold, m.n, 2*l.label-1 as y, {_SC} from mo m join lab l on l.ticker=m.ticker and l.rn<=m.cut and l.ok and l.label is not null)",
    "gd as (select ticker, fold, 0 as k, 0e0 as b, 0e0 as w1, 0e0 as w2, 0e0 as w3 from mo union all "
    "select g.ticker, g.fold, any_value(g.k)+1, any_value(g.b)+sum(0.5*t.y/(1+exp(t.y*(g.b+g.w1*z1+g.w2*z2+g.w3*z3))))/(1+0.5*any_value(t.n)), "
    + ", ".join(f"any_value(g.w{i})+(sum(0.5*t.y*z{i}/(1+exp(t.y*(g.b+g.w1*z1+g.w2*z2+g.w3*z3))))-any_value(g.w{i}))/(1+0.5*any_value(t.n))" for i in (1, 2, 3))
    + " from gd g join tr t on t.ticker=g.ticker and t.fold=g.fold where g.k<2500 group by g.ticker, g.fold)",
    "md as (select * from gd where k=2500)",
    f"sc as (select l.ticker, l.date, l.fold, d.b+{'+'.join(f'd.w{i}*(l.{n}-m.a{i})/m.s{i}' for i, n in enumerate(THREE, 1))} as score from fld l join mo m on m.ticker=l.ticker and m.fold=l.fold join md d on d.ticker=l.ticker and d.fold=l.fold)")


@query("ml_logistic_scores", ctes(*LOGIT, recursive=True) + f"select ticker, date, fold, {r('score', 5)} as score, cast(score>0 as integer) as pred from sc")
def _(t):
    rows = cut_lineage(w.labelled(v.weekly_bars(t), OPTS, THREE))
    return rounded(linear.logistic_regression(rows, OPTS, 0.5, width=3), 5)


# The first boosted tree needs no draws: two levels of best splits over all cuts of three features.
_FINE = "1073741824e0"


def _level(name: str, rows: str) -> str:
    """Best split of every node of ``rows`` (ticker, fold, node, rn, g, h)."""
    return (f"{name}c as materialized (select r.ticker, r.fold, r.node, e.feature, e.bin, e.threshold, count(*) filter (where l.x<=e.threshold) as lr, count(*) as tr, "
            f"coalesce(sum(r.h) filter (where l.x<=e.threshold),0)/{_FINE} as ln, coalesce(sum(r.g) filter (where l.x<=e.threshold),0)/{_FINE} as ls, sum(r.h)/{_FINE} as tn, sum(r.g)/{_FINE} as ts "
            f"from {rows} r join long l using (ticker,fold,rn) join edges e on e.ticker=r.ticker and e.fold=r.fold and e.feature=l.feature group by 1,2,3,4,5,6),\n"
            f"{name}s as (select *, ls*ls/(ln+1)+(ts-ls)*(ts-ls)/((tn-ln)+1)-ts*ts/(tn+1) as score from {name}c where lr>0 and lr<tr and ln>=1 and tn-ln>=1),\n"
            f"{name} as materialized (select * from {name}s where score>1e-6 qualify row_number() over (partition by ticker,fold,node order by score desc, feature, bin)=1)")


def _moved(name: str, rows: str, split: str) -> str:
    return (f"{name} as materialized (select r.ticker, r.fold, 2*r.node+case when l.x<=s.threshold then 0 else 1 end as node, r.rn, r.g, r.h "
            f"from {rows} r join {split} s using (ticker,fold,node) join long l on l.ticker=r.ticker and l.fold=r.fold and l.rn=r.rn and l.feature=s.feature)")


BOOSTED = (
    *LOGIT[:-5],
    "base as materialized (select ticker, fold, train_rows, positives/train_rows as p from fits where fitted)",
    f"gh as materialized (select b.ticker, b.fold, 1 as node, l.rn, {', '.join(f'l.{n}' for n in THREE)}, round_even((p-l.label)*{_FINE},0) as g, round_even(p*(1-p)*{_FINE},0) as h "
    "from base b join fits c using (ticker,fold) join lab l on l.ticker=b.ticker and l.rn<=c.cut and l.ok and l.label is not null)",
    "long as materialized (" + " union all ".join(f"select ticker, fold, rn, {i} as feature, {n} as x from gh" for i, n in enumerate(THREE)) + ")",
    "rk as (select *, row_number() over (partition by ticker,fold,feature order by x) as k, count(*) over (partition by ticker,fold,feature) as n from long)",
    "vals as (select distinct ticker, fold, feature, x from rk where (k*256)//n>((k-1)*256)//n)",
    "edges as materialized (select ticker, fold, feature, row_number() over w as bin, (x+lead(x) over w)/2 as threshold from vals window w as (partition by ticker,fold,feature order by x) qualify threshold is not null)",
    _level("s1", "gh"), _moved("r2", "gh", "s1"), _level("s2", "r2"), _moved("r3", "r2", "s2"),
    "nodes as (" + " union all ".join(f"select ticker, fold, node, count(*) as rows, sum(g)/{_FINE} as s, sum(h)/{_FINE} as n from {x} group by 1,2,3" for x in ("gh", "r2", "r3")) + ")",
    "splits as (select * from s1 union all select * from s2)")


@query("ml_boosted_first_tree", ctes(*BOOSTED, recursive=True)
       + f"select ticker, fold, -1 as tree, 1::bigint as node, train_rows as rows, {r('ln(p/(1-p))')} as value, cast(null as integer) as feature, cast(null as double) as threshold from base union all "
       f"select ticker, fold, 0, node::bigint, rows, {r('-0.3*n.s/(n.n+1)')}, s.feature, {r('s.threshold')} from nodes n left join splits s using (ticker,fold,node)")
def _(t):
    rows = cut_lineage(w.labelled(v.weekly_bars(t), OPTS, THREE))
    return rounded(trees.fit_boosted(rows, OPTS, 1, 2, 0.3, width=3).drop("cut"))


# A grid of classifiers through the search: shared moments and neighbour lists, one set that can't be evaluated.
NB_SETS = [{"lookback": 42, "forward": 5, "var_smoothing": x, "long_short": ls} for x in (1e-3, 1e-2) for ls in (True, False)]
KNN_SETS = [{"lookback": 42, "forward": 5, "n_neighbors": n, "weights": wt, "p": 2} for n, wt in ((7, "distance"), (7, "uniform"), (15, "uniform"), (400, "uniform"))]


def _nb_text(x: float, ls: bool) -> str:
    return canonical({"lookback": 42, "forward": 5, "var_smoothing": x, "long_short": ls})


def _nb_scores(i: int, x: str) -> str:
    return (f"n{i} as (select f.ticker, f.date, cast(ln(k1.n_/(k0.n_+k1.n_))-0.5*({_ll(1).replace('1e-3', x)})>ln(k0.n_/(k0.n_+k1.n_))-0.5*({_ll(0).replace('1e-3', x)}) as integer) as pred "
            "from fld f join mom using (ticker,fold) join k0 using (ticker,fold) join k1 using (ticker,fold))")


def _votes(text: str, n: int, up: str) -> str:
    return f"select ticker, date, '{text}' as params, true as ls, cast(sum(case when label=1 then {up} else 0 end)>sum(case when label=0 then {up} else 0 end) as integer) as pred from top where k<={n} group by 1,2"


GRID = (
    *LAB, MOM, _cls(0), _cls(1), _nb_scores(0, "1e-3"), _nb_scores(1, "1e-2"),
    f"prs as (select f.ticker, f.date, g.label, sqrt({_DIST}) as d from fld f join fits c using (ticker,fold) join mom using (ticker,fold) join lab g on g.ticker=f.ticker and g.rn<=c.cut and g.ok and g.label is not null where c.fitted)",
    "top as materialized (select *, row_number() over (partition by ticker,date order by d) as k from prs)",
    "prd as materialized (" + " union all ".join(
        [f"select ticker, date, '{_nb_text(x, ls)}' as params, {str(ls).lower()} as ls, pred from n{i}" for i, x in enumerate((1e-3, 1e-2)) for ls in (True, False)]
        + [_votes(canonical(p), p["n_neighbors"], "1/d" if p["weights"] == "distance" else "1") for p in KNN_SETS[:3]]) + ")",
    *dev_sql(), "sets as (select distinct params, ls from prd)",
    "c2 as materialized (select dev.*, sets.params, case when pred=1 then 1e0 when pred=0 and sets.ls then -1e0 else 0e0 end as target from dev cross join sets left join prd on prd.ticker=dev.ticker and prd.date=dev.date and prd.params=sets.params)",
    ledger_sql("c2", keys="ticker,params", lag=1, k="0.00025"), metrics_sql("led", keys="ticker,params,period"),
    "wide as (select ticker, params, max(case when undefined_ then -99.0 else sharpe0 end) filter (where period='val') as val_sharpe, max(case when undefined_ then -99.0 else sharpe0 end) filter (where period='train') as train_sharpe, "
    "max(n_observations) filter (where period='val') as val_n_observations, max(trade_count) filter (where period='val') as val_trade_count, max(max_drawdown) filter (where period='val') as val_max_drawdown from met group by 1,2)")


@query("sea_classifier_grid", ctes(*GRID, recursive=True)
       + "select ticker, case when params like '%var_smoothing%' then 'ml_nb' else 'ml_knn' end as strategy, params, cast(null as varchar) as error, val_sharpe, train_sharpe, val_n_observations, val_trade_count, val_max_drawdown from wide "
       f"union all select distinct ticker, 'ml_knn', '{canonical(KNN_SETS[3])}', 'n_neighbors exceeds the rows of the first training window', cast(null as double), cast(null as double), cast(null as bigint), cast(null as bigint), cast(null as double) from weekly")
def _(t):
    res = run_search(v.weekly_bars(t), ["ml_nb", "ml_knn"], SEARCH, {"ml_nb": NB_SETS, "ml_knn": KNN_SETS})
    return res.select("ticker", "strategy", "params", "error", "val_sharpe", "train_sharpe", "val_n_observations", "val_trade_count", "val_max_drawdown")
