"""Evaluate a whole grid of candidates over all tickers as one job.

bars -> panel (indicators once per ticker) -> join grid -> targets -> smoothing
variants -> ledger -> metrics. Two tables cross the network: the panel and the
candidates that are still wanted, one row per ticker and candidate. Both are
partitioned by (ticker, indicator setting, chunk) and joined inside those
partitions, and every later window and aggregate is keyed by columns that
contain the partitioning, so bars x candidates rows are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..session import cut_lineage
from . import grid as g
from . import learners
from .ledger import MARKET, LedgerOptions, constant_market, ledger, proportional_ledger, sequential_ledger, with_market
from .metrics import ACTIVITY_METRICS, RETURN_METRICS, period_metrics, with_period_drawdown
from .selection import survivors
from .splits import halving_resources, with_folds, with_periods
from .strategies import Strategy, get_strategy
from .walkforward import CLASSIFIERS, ML_GRIDS, ML_SMOOTH, classifier_positions

ORDER = k.RECURSION_ORDER


def _session(base):
    return base.sparkSession if isinstance(base, DataFrame) else base


@dataclass(frozen=True)
class Candidates:
    """A search space: a product grid, or an explicit list of parameter sets."""

    strategy: Strategy
    grid: Mapping[str, Sequence] | None
    rows: Sequence[Mapping] | None
    smooth: Sequence[int]

    @property
    def names(self) -> list[str]:
        """Parameters that decide the unsmoothed target."""
        return list(self.grid) if self.grid is not None else [n for n in self.rows[0] if n != "signal_smooth"]

    @property
    def size(self) -> int:
        return (g.grid_size(self.grid) if self.grid is not None else len(self.rows)) * len(self.smooth)

    def settings(self) -> list[dict]:
        if self.grid is not None:
            return g.combinations(self.grid, self.strategy.on, self.strategy.valid)
        return list({tuple(row[n] for n in self.strategy.on): {n: row[n] for n in self.strategy.on} for row in self.rows}.values())

    def values(self) -> dict[str, list]:
        return dict(self.grid) if self.grid is not None else {n: [row[n] for row in self.rows] for n in self.names}

    def table(self, base) -> DataFrame:
        """pid and the parameters; a list also pins each row's smoothing span."""
        if self.grid is not None:
            return g.build_grid(base, self.grid, self.strategy.valid).drop("params")
        spans = [{**row, "_span": row.get("signal_smooth", 0)} for row in self.rows]
        return g.build_rows(base, spans, [*self.names, "_span"]).drop("params")

    def labels(self, base) -> DataFrame:
        """pid, signal_smooth and the canonical params text."""
        if self.grid is None:
            return g.build_rows(base, self.rows, self.names).select(
                *(["ticker"] if isinstance(base, DataFrame) else []), "pid", "params").join(self.table(_session(base)).select("pid", F.col("_span").alias("signal_smooth")), "pid")
        full = g.build_grid(base, {**self.grid, "signal_smooth": self.smooth}, self.strategy.valid)
        return full.select(F.floor(F.col("pid") / len(self.smooth)).alias("pid"), "signal_smooth", "params",
                           *([c for c in ("ticker",) if c in full.columns]))


def space(name: str, grid=None, smooth: Sequence[int] | None = None) -> Candidates:
    strategy = get_strategy(name)
    if grid is not None and not isinstance(grid, Mapping):
        rows = [{**strategy.defaults, **row} for row in grid]
        return Candidates(strategy, None, rows, sorted({row.get("signal_smooth", 0) for row in rows}))
    grid = dict(grid or strategy.grid)
    own = grid.pop("signal_smooth", None)
    smooth = list(smooth if smooth is not None else own if own is not None else strategy.smooth)
    grid.update({n: [strategy.defaults[n]] for n in set(strategy.grid) - set(grid)})
    return Candidates(strategy, grid, None, smooth)


#: identity of a candidate's rows; ``unit`` hashes (ticker, indicator setting, chunk) and is what partitions them
UNIT = ("unit", "ticker", "pid")
CANDIDATE = (*UNIT, "signal_smooth")


def task_count(spark) -> int:
    """Tasks of the exploded stages: a few per core, and never fewer than the configured shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def with_unit(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``unit``, a 64-bit hash of (ticker, indicator setting, chunk); numbers hash alike whatever their type."""
    kinds = dict(df.dtypes)
    parts = [F.col(c).cast("double") if kinds[c] in ("int", "bigint", "double", "float") or kinds[c].startswith("decimal") else F.col(c) for c in on]
    return df.withColumn("unit", F.xxhash64("ticker", *parts, "chunk"))


def candidate_targets(bars: DataFrame, found: Candidates, chunks: int = 1, only: DataFrame | None = None) -> DataFrame:
    """Bars x candidates with ``target``; ``only`` restricts to given (ticker, pid, signal_smooth) rows.

    ``chunks`` replicates the panel so that candidates of one indicator setting
    spread over several tasks.
    """
    strategy, names, smooth = found.strategy, found.names, found.smooth
    panel = strategy.panel(bars, found.settings(), found.values())
    values = [c for c in panel.columns if c.startswith("v") and c[1:].isdigit()]
    carried = [c for c in dict.fromkeys([*bars.columns, *ORDER]) if c not in strategy.on]
    panel = panel.select(*carried, *strategy.on, *values)
    spread = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))) if chunks > 1 else F.lit(0)
    # an explicit count: the panel is small, what is built inside its partitions is not, so it must not be coalesced
    tasks = task_count(bars.sparkSession)
    panel = with_unit(panel.withColumn("chunk", spread), strategy.on).repartition(tasks, "unit")
    rows = found.table(bars.select("ticker").distinct()).withColumn("chunk", F.pmod("pid", F.lit(chunks)).cast("int"))
    if only is not None:  # before any bar is multiplied
        rows = rows.join(only.select("ticker", "pid").distinct(), ["ticker", "pid"], "left_semi")
    rows = with_unit(rows, strategy.on).drop("ticker", "chunk", *strategy.on).repartition(tasks, "unit")
    df = panel.join(rows, "unit")
    extra = [c for c in ("position_size", "_span") if c in rows.columns]
    if strategy.machine is not None:
        df = strategy.machine(df.select(*carried, "unit", "pid", *values, *strategy.machine_params, *extra), UNIT)
    else:
        df = df.withColumn("target", strategy.signal({n: F.col(n) for n in names}))
    df = df.select(*carried, "unit", "pid", "target", *extra)
    spans = [s for s in smooth if s > 0]
    if spans:
        df = k.with_ewm(df, [("target", k.span_alpha(s), f"_sm_{s}") for s in spans], UNIT)
    variants = F.array(*[
        F.struct(F.lit(s).alias("signal_smooth"), F.col(f"_sm_{s}" if s > 0 else "target").alias("_target")) for s in smooth
    ])
    df = df.select(*[c for c in df.columns if not c.startswith("_sm_")], F.inline(variants))
    if "_span" in extra:
        df = df.filter(F.col("signal_smooth") == F.col("_span"))
    target = F.col("_target") * F.col("position_size") if "position_size" in extra else F.col("_target")
    df = df.withColumn("target", target).drop("_target", *extra)
    if only is not None:
        df = df.join(only.select("ticker", "pid", "signal_smooth"), ["ticker", "pid", "signal_smooth"], "left_semi")
    return df


def positions(bars: DataFrame, name: str, keep: Sequence[str] = (), **params) -> DataFrame:
    """``ticker, date, target`` of one parameter set (missing ones take the strategy's defaults).

    ``keep`` carries further columns of ``bars`` along, which saves joining the
    targets back to a table that would have to be scanned twice.
    """
    smooth = int(params.pop("signal_smooth", 0))
    size = params.pop("position_size", None)
    if name in CLASSIFIERS:
        df = classifier_positions(bars, name, **params)
        if smooth > 0:
            df = k.with_ewm(df, [("target", k.span_alpha(smooth), "_sm")], ("ticker",)).withColumn("target", F.col("_sm"))
        df = df.withColumn("target", F.col("target") * float(1 if size is None else size)).select("ticker", "date", "target")
        return df.join(bars.select("ticker", "date", *keep), ["ticker", "date"]).select("ticker", "date", *keep, "target") if keep else df
    strategy = get_strategy(name)
    unknown = set(params) - set(strategy.grid)
    if unknown:
        raise ValueError(f"unknown parameters for {name}: {sorted(unknown)}")
    full = {**strategy.defaults, **params}
    grid = {n: [full[n]] for n in strategy.grid}
    if size is not None:
        grid["position_size"] = [float(size)]
    relaxed = {**strategy.__dict__, "valid": lambda p: F.lit(True) if hasattr(next(iter(p.values()), None), "isNull") else True}
    return _run_single(Strategy(**relaxed), bars, grid, smooth, keep)


def _run_single(strategy: Strategy, bars: DataFrame, grid: Mapping, smooth: int, extra: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in ("ticker", "date", "open", "high", "low", "close", "ann") if c in bars.columns]
    if "ann" not in cols:
        from ..functions.scalars import annualization
        bars, cols = bars.withColumn("ann", annualization(F.col("ticker"))), [*cols, "ann"]
    panel = strategy.panel(bars.select(*dict.fromkeys([*cols, *extra])), g.combinations(grid, strategy.on), grid)
    params = {n: F.lit(float(v[0]) if isinstance(v[0], float) else g.plain(v[0])) for n, v in grid.items()}
    if strategy.machine is not None:
        df = panel.withColumns({n: params[n] for n in strategy.machine_params if n not in strategy.on})
        keep = ["ticker", "date", *ORDER, *extra, *strategy.machine_params]
        values = [c for c in df.columns if c.startswith("v") and c[1:].isdigit()]
        df = strategy.machine(df.select(*dict.fromkeys(keep), *values), ("ticker",))
    else:
        df = panel.withColumn("target", strategy.signal(params))
    if smooth > 0:
        df = k.with_ewm(df, [("target", k.span_alpha(smooth), "_sm")], ("ticker",)).withColumn("target", F.col("_sm"))
    if "position_size" in grid:
        df = df.withColumn("target", F.col("target") * params["position_size"])
    return df.select(*dict.fromkeys(["ticker", "date", *extra, "target"]))


def development_bars(bars: DataFrame, opts: LedgerOptions, folds: int = 4, schedules=None) -> DataFrame:
    """Bars with market columns, split periods and folds; the sealed test rows are removed."""
    marked = with_folds(with_periods(with_market(bars, opts, schedules)), folds)
    if opts.proportional:
        marked = marked.drop(*constant_market(opts, schedules or ()), "m_price", "m_volume")
    return marked.filter(F.col("period").isin("train", "val"))


def candidate_ledgers(bars: DataFrame, found: Candidates, opts: LedgerOptions, chunks: int = 1,
                      only: DataFrame | None = None) -> DataFrame:
    """Ledger rows of every candidate; ``bars`` already carry the market columns."""
    df = candidate_targets(bars, found, chunks, only)
    if opts.proportional:
        return proportional_ledger(df, opts, CANDIDATE, ORDER, keep_log=True)
    return sequential_ledger(df, opts, ("unit", "ticker"), ("pid", "signal_smooth"), "_seq")


def evaluate_grid(bars: DataFrame, name: str, opts: LedgerOptions, grid=None, smooth=None, folds: int = 4,
                  chunks: int = 1, risk_free_rate: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """One result row per (ticker, candidate): train and validation metrics and fold Sharpes.

    ``bars`` come from :func:`development_bars` (or a prefix of it).
    """
    found = space(name, grid, smooth)
    led = candidate_ledgers(bars, found, opts, chunks, only)
    if "log_equity" in led.columns:
        led = with_period_drawdown(led, CANDIDATE, ORDER, ("train", "val"))
    names = found.labels(bars.sparkSession)
    return _result_rows(_wide_metrics(led, CANDIDATE, ORDER, folds, risk_free_rate).join(names, ["pid", "signal_smooth"]), name)


def _wide_metrics(led: DataFrame, keys, order, folds: int, risk_free_rate: float) -> DataFrame:
    """Training and validation metrics of a candidate in one row."""
    long = period_metrics(led, (*keys, "period"), risk_free_rate, order, folds)
    metrics = [m for m in (*RETURN_METRICS, *ACTIVITY_METRICS)]
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("period") == p, F.col(m))).alias(f"{p}_{m}") for p in ("train", "val") for m in metrics],
        F.max(F.when(F.col("period") == "val", F.col("fold_sharpes"))).alias("val_fold_sharpes"),
    )


def _result_rows(wide: DataFrame, name: str, complaint=None) -> DataFrame:
    """The columns of a result; numbers out of range, or a ``complaint`` about the parameters, become the error."""
    metrics = [m for m in (*RETURN_METRICS, *ACTIVITY_METRICS)]
    bad = F.lit(False)
    for m in RETURN_METRICS:
        x = F.col(f"val_{m}")
        bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
    error = F.when(F.coalesce(bad, F.lit(False)), "evaluation metrics exceed numerical range")
    return (
        wide.withColumn("strategy", F.lit(name))
        .withColumn("error", error if complaint is None else F.coalesce(complaint, error))
        .select("ticker", "strategy", "params", "pid", "signal_smooth", "error",
                *[f"{p}_{m}" for p in ("train", "val") for m in metrics], "val_fold_sharpes")
    )


def evaluate_classifiers(bars: DataFrame, name: str, opts: LedgerOptions, rows: Sequence[Mapping], folds: int = 4,
                         risk_free_rate: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """Results of many parameter sets of one classifier in one plan, as :func:`evaluate_grid` gives them for the rules.

    What sets share is computed once (see ``learners``). A set that can't be evaluated is a row with an error and no metrics.
    Training sees the whole history up to each fold's cut, as the positions of one parameter set do. ``only`` restricts to
    given (ticker, params) rows.
    """
    named = learners.labels(bars, name, rows)
    if only is not None:
        named = named.join(only.select("ticker", "params").distinct(), ["ticker", "params"], "left_semi")
    targets = learners.grid_targets(bars, name, rows).join(named.select("ticker", "pid"), ["ticker", "pid"], "left_semi")
    led = ledger(development_bars(bars, opts, folds).join(targets, ["ticker", "date"]), opts, ("ticker",), ("pid",))
    wide = _wide_metrics(led, ("ticker", "pid"), ("date",), folds, risk_free_rate)
    return _result_rows(named.join(wide, ["ticker", "pid"], "left"), name, F.col("complaint"))


def classifier_rows(name: str, grid=None, smooth: Sequence[int] | None = None) -> list[dict]:
    """The parameter sets of a classifier's grid (its whole search space by default), or the given list of sets."""
    if grid is not None and not isinstance(grid, Mapping):
        return [dict(row) for row in grid]
    full = {**(grid or ML_GRIDS[name]), "signal_smooth": list(smooth if smooth is not None else ML_SMOOTH)}
    return g.combinations(full, list(full))


def run_search(bars: DataFrame, strategies: Sequence[str], opts: LedgerOptions, grids: Mapping | None = None,
               folds: int = 4, chunks: int = 1, risk_free_rate: float = 0.0, done: DataFrame | None = None,
               smooth: Sequence[int] | None = None) -> DataFrame:
    """Results of several strategies; candidates already in ``done`` (ticker, strategy, params) are skipped."""
    dev = development_bars(bars, opts, folds)
    out = None
    for name in strategies:
        only = None
        if name in CLASSIFIERS:
            rows = classifier_rows(name, (grids or {}).get(name), smooth)
            if done is not None:
                only = learners.labels(bars, name, rows).join(
                    done.where(F.col("strategy") == name).select("ticker", "params"), ["ticker", "params"], "left_anti")
            part = evaluate_classifiers(bars, name, opts, rows, folds, risk_free_rate, only)
            out = part if out is None else out.unionByName(part)
            continue
        if done is not None:
            only = remaining(dev, name, done, (grids or {}).get(name), smooth)
        part = evaluate_grid(dev, name, opts, (grids or {}).get(name), smooth, folds, chunks, risk_free_rate, only)
        out = part if out is None else out.unionByName(part)
    return out


def candidate_table(bars: DataFrame, name: str, grid=None, smooth=None) -> DataFrame:
    """(ticker, strategy, params, pid, signal_smooth) of a grid, without evaluating it."""
    full = space(name, grid, smooth).labels(bars.select("ticker").distinct())
    return full.select("ticker", F.lit(name).alias("strategy"), "params", "pid", "signal_smooth")


def remaining(bars: DataFrame, name: str, done: DataFrame, grid=None, smooth=None) -> DataFrame:
    """Candidates without a stored result (resume)."""
    todo = candidate_table(bars, name, grid, smooth)
    return todo.join(done.select("ticker", "strategy", "params"), ["ticker", "strategy", "params"], "left_anti")


def ledger_of(bars: DataFrame, name: str, opts: LedgerOptions, schedules=None, **params) -> DataFrame:
    """Ledger of one parameter set on every ticker, in one scan of the bars."""
    market = with_market(bars, opts, schedules)
    return ledger(positions(market, name, keep=MARKET, **params), opts)


def frozen_metrics(bars: DataFrame, winners: DataFrame, opts: LedgerOptions, grids: Mapping, smooth: Sequence[int] | None = None,
                   risk_free_rate: float = 0.0, periods: Sequence[str] = ("val", "test")) -> DataFrame:
    """Metrics of each ticker's frozen winner and of buy-and-hold on the same bars, test window included.

    ``winners`` has one (ticker, strategy, params, pid, signal_smooth) row per ticker.
    """
    marked = with_periods(with_market(bars, opts))
    out = None
    for name, grid in grids.items():
        mine = winners.filter(F.col("strategy") == name)
        led = candidate_ledgers(marked, space(name, grid, smooth), opts, only=mine)
        if "log_equity" in led.columns:
            led = with_period_drawdown(led, CANDIDATE, ORDER)
        part = period_metrics(led, (*CANDIDATE, "period"), risk_free_rate, ORDER).drop("unit")
        part = part.join(mine.select("ticker", "pid", "signal_smooth", "strategy", "params"), ["ticker", "pid", "signal_smooth"])
        out = part if out is None else out.unionByName(part)
    held = ledger(marked.withColumn("target", F.lit(1.0)), opts)
    base = period_metrics(held, ("ticker", "period"), risk_free_rate).withColumns({
        "pid": F.lit(None).cast("bigint"), "signal_smooth": F.lit(None).cast("int"), "strategy": F.lit("buy_and_hold"), "params": F.lit("{}")})
    both = out.withColumn("account", F.lit("selected")).unionByName(base.withColumn("account", F.lit("benchmark")))
    return both.filter(F.col("period").isin(*periods)).drop("pid", "signal_smooth")


def stage_bars(dev: DataFrame, resources: DataFrame, stage: int) -> DataFrame:
    """Development bars of one halving stage: all training rows and the first validation rows."""
    w = Window.partitionBy("ticker", "period").orderBy("date")
    cut = resources.filter(F.col("stage") == stage).select("ticker", "resource_bars")
    rows = dev.withColumn("_v", F.row_number().over(w)).join(cut, "ticker")
    rows = rows.filter((F.col("period") == "train") | (F.col("_v") <= F.col("resource_bars"))).drop("_v", "resource_bars", "fold")
    return with_folds(rows, FOLDS)


FOLDS = 4


def successive_halving(bars: DataFrame, strategies: Sequence[str], opts: LedgerOptions, grids: Mapping | None = None,
                       smooth: Sequence[int] | None = None, stages: int = 3, factor: int = 3, minimum: int = 2,
                       chunks: int = 1, risk_free_rate: float = 0.0, done: DataFrame | None = None) -> DataFrame:
    """Score all candidates on a short validation prefix, keep the best share, repeat on longer prefixes.

    ``done`` has the rows of earlier stages that an interrupted run has left; such a stage is taken as it is, the others follow.

    Returns one row per (stage, ticker, candidate) with its metrics, score and
    whether it advanced; the last stage holds the full-history results. Every
    stage is written before the next one reads its survivors, so a lost
    executor never replays earlier stages. Only the number of stages loops on
    the driver.
    """
    dev = development_bars(bars, opts, FOLDS)
    totals = dev.filter("period = 'val'").groupBy("ticker").agg(F.count(F.lit(1)).alias("total"))
    resources = cut_lineage(halving_resources(totals, "total", stages, factor, minimum))
    alive, history = None, None
    stored = set() if done is None else {r["stage"] for r in done.select("stage").distinct().collect()}  # a handful of stages
    for stage in range(stages):
        if stage in stored:
            marked = done.filter(F.col("stage") == stage)
            alive = marked.filter("advanced")
            history = marked if history is None else history.unionByName(marked)
            continue
        rows = stage_bars(dev, resources, stage)
        scored = None
        for name in strategies:
            only = None if alive is None else alive.filter(F.col("strategy") == name)
            part = evaluate_grid(rows, name, opts, (grids or {}).get(name), smooth, FOLDS, chunks, risk_free_rate, only)
            scored = part if scored is None else scored.unionByName(part)
        marked = survivors(scored, factor).withColumn("stage", F.lit(stage)).join(
            resources.select("ticker", "stage", "resource_bars"), ["ticker", "stage"])
        last = resources.groupBy("ticker").agg(F.max("stage").alias("_last"))
        marked = marked.join(last, "ticker").withColumn("advanced", F.col("advanced") & (F.col("stage") < F.col("_last"))).drop("_last")
        marked = cut_lineage(marked)
        alive = marked.filter("advanced")
        history = marked if history is None else history.unionByName(marked)
    return history
