"""How stable is a candidate when each parameter moves a little?"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import canonical, neighbour_rows
from .ledger import LedgerOptions
from .search import evaluate_grid, space
from .strategies import get_strategy


def neighbour_scores(dev: DataFrame, name: str, params: Mapping, opts: LedgerOptions, frac: float = 0.2,
                     risk_free_rate: float = 0.0) -> DataFrame:
    """Validation Sharpe of the candidate (``baseline``) and of its valid neighbours, per ticker, in one job."""
    strategy = get_strategy(name)
    full = {**strategy.defaults, "signal_smooth": 0, **params}
    kinds = {n: "int" if isinstance(x, int) else "double" for n, x in full.items() if isinstance(x, int | float) and not isinstance(x, bool)}
    one = dev.sparkSession.createDataFrame([tuple(full[n] for n in kinds)], ", ".join(f"{n} {'bigint' if t == 'int' else t}" for n, t in kinds.items()))
    # two rows for each numeric parameter at most
    around = [{**full, r["moved"]: r[r["moved"]]} for r in neighbour_rows(one, kinds, frac).collect()]
    around = [row for row in around if strategy.params_valid(row)]
    rows = evaluate_grid(dev, name, opts, [full, *around], risk_free_rate=risk_free_rate)
    return rows.select("ticker", "strategy", "params", (F.col("params") == canonical(full)).alias("baseline"),
                       F.when(F.col("error").isNull(), F.col("val_sharpe")).otherwise(-99.0).alias("val_sharpe"))


def _sets_around(spark: SparkSession, strategy, bases: list[dict], frac: float) -> list[tuple[str, dict, bool]]:
    """(canonical base, parameter set, is the base) of every base and of its valid neighbours, one job per mix of number types."""
    numeric = lambda full: tuple((n, "int" if isinstance(x, int) else "double") for n, x in sorted(full.items()) if isinstance(x, int | float) and not isinstance(x, bool))
    out = [(canonical(full), full, True) for full in bases]
    for kinds in dict.fromkeys(map(numeric, bases)):
        alike = {i: full for i, full in enumerate(bases) if numeric(full) == kinds}
        schema = ", ".join(["_base int", *[f"{n} {'bigint' if t == 'int' else t}" for n, t in kinds]])
        table = spark.createDataFrame([(i, *[full[n] for n, _ in kinds]) for i, full in alike.items()], schema)
        for r in neighbour_rows(table, dict(kinds), frac).collect():
            moved = {**alike[r["_base"]], r["moved"]: r[r["moved"]]}
            if strategy.params_valid(moved):
                out.append((canonical(alike[r["_base"]]), moved, False))
    return out


def winner_scores(dev: DataFrame, winners: DataFrame, name: str, opts: LedgerOptions, frac: float = 0.2, chunks: int = 1,
                  risk_free_rate: float = 0.0) -> DataFrame:
    """:func:`neighbour_scores` around each ticker's own winner of strategy ``name``.

    ``winners`` has ticker, strategy and params (canonical, as a search returns them), such as ``selection.top`` gives. The driver
    sees the distinct parameter sets among them, which the search space bounds whatever the number of tickers. Each ticker
    evaluates the sets around its own winner only; sets that several winners share are one candidate. Without winners of
    that strategy there are no rows.
    """
    spark, strategy = dev.sparkSession, get_strategy(name)
    mine = winners.where(F.col("strategy") == name).select("ticker", F.col("params").alias("_base")).distinct()
    bases = [(r["_base"], {**strategy.defaults, "signal_smooth": 0, **json.loads(r["_base"])}) for r in mine.select("_base").distinct().orderBy("_base").collect()]
    if not bases:
        return spark.createDataFrame([], "ticker string, strategy string, params string, baseline boolean, val_sharpe double")
    given = {canonical(full): text for text, full in bases}
    around = _sets_around(spark, strategy, [full for _, full in bases], frac)
    sets = {canonical(row): row for _, row, _ in around}
    pairs = spark.createDataFrame([(given[base], canonical(row), is_base) for base, row, is_base in around], "_base string, params string, baseline boolean")
    wanted = mine.join(pairs, "_base").select("ticker", "params", "baseline")
    names = space(name, list(sets.values())).labels(spark).select("pid", "signal_smooth", "params")
    rows = evaluate_grid(dev, name, opts, list(sets.values()), chunks=chunks, risk_free_rate=risk_free_rate,
                         only=wanted.join(names, "params").select("ticker", "pid", "signal_smooth"))
    return rows.join(wanted, ["ticker", "params"]).select(
        "ticker", "strategy", "params", "baseline", F.when(F.col("error").isNull(), F.col("val_sharpe")).otherwise(-99.0).alias("val_sharpe"))


def robustness(scores: DataFrame, by=("ticker", "strategy"), min_neighbours: int = 4) -> DataFrame:
    """Neighbourhood statistics, grade and verdict per group of :func:`neighbour_scores` rows."""
    mine = scores.groupBy(*by).agg(F.max(F.when(F.col("baseline"), F.col("val_sharpe"))).alias("base"))
    rows = scores.filter(~F.col("baseline")).join(mine, list(by))
    x, ok = F.col("val_sharpe"), F.col("val_sharpe") > -99
    v = F.when(ok, x)
    stats = rows.groupBy(*by, "base").agg(
        F.count(F.lit(1)).alias("tried"), F.count_if(ok).alias("n_neighbours"), F.avg(v).alias("mean"),
        F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(F.when(ok, (x < F.col("base") * 0.5).cast("double"))).alias("pct_degrade"),
        F.avg(F.when(ok, (x > 0).cast("double"))).alias("pct_positive"))
    skipped = (F.col("tried") < min_neighbours) | (F.col("n_neighbours") == 0)
    base, med, worse = F.col("base"), F.col("median"), F.col("pct_degrade")
    grade = (
        F.when(skipped, "N/A").when((base > 0) & (med >= 0.8 * base) & (worse < 0.15), "A")
        .when((base > 0) & (med >= 0.6 * base) & (worse < 0.35), "B")
        .when(med >= 0.4 * F.greatest(base, F.lit(0.0)), "C").otherwise("D"))
    out = stats.withColumn("grade", grade)
    verdict = (F.when(F.col("grade") == "A", "Robust").when(F.col("grade") == "B", "Relatively stable")
               .when(F.col("grade") == "C", "Fragile").when(F.col("grade") == "D", "Locally unstable").otherwise("Skipped"))
    peak = F.coalesce((base > 0) & ((med < 0.5 * base) | (worse > 0.4)), F.lit(False))
    return out.withColumns({"isolated_peak": F.when(~skipped, peak), "verdict": verdict})
