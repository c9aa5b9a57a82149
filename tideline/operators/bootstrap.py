"""Paired circular moving-block bootstrap of return series, many series at once.

A resample only needs sums over its blocks, so every series gets one row per
start with the sums of the block that begins there. A draw is then one equi-join
on (series, start) and one aggregate; the resampled rows are never materialised.
Values are centred on the series mean first, so sums of squares keep precision.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .grid import uniform_hash

STATISTICS = ("strategy_annualized_mean", "strategy_sharpe", "benchmark_annualized_mean", "benchmark_sharpe", "annualized_mean_excess")
MIN_STD = 1e-12
MIN_BLOCKS = 5


@dataclass(frozen=True)
class BootstrapOptions:
    n_resamples: int = 2000
    block_length: int = 10
    confidence_level: float = 0.95
    seed: int = 42
    min_observations: int = 60
    annualization: float = 252.0
    risk_free_rate: float = 0.0
    draws: str = "hash"

    def __post_init__(self):
        if not 200 <= self.n_resamples <= 20_000 or not 1 <= self.block_length <= 1_000_000:
            raise ValueError("n_resamples lies between 200 and 20000, block_length between 1 and a million")
        if not 0 <= self.seed < 2**32 or not 2 <= self.min_observations <= 1_000_000:
            raise ValueError("seed or min_observations out of range")
        if not 0 < self.confidence_level < 1 or self.n_resamples * (1 - self.confidence_level) / 2 < 5 - 1e-10:
            raise ValueError("too few resamples for this confidence level: each tail needs five or more")
        if self.draws not in ("hash", "pcg64"):
            raise ValueError("draws must be hash or pcg64")


def pair_returns(strategy: DataFrame, benchmark: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the two return tables on identical dates; a date on one side only fails the job."""
    a = strategy.select(*keys, "date", F.col("ret").alias("strategy"))
    b = benchmark.select(*keys, "date", F.col("ret").alias("benchmark"))
    both = a.join(b, [*keys, "date"], "full_outer")
    odd = F.col("strategy").isNull() | F.col("benchmark").isNull()
    fail = F.raise_error(F.lit("strategy and benchmark dates must match exactly")).cast("double")
    return both.withColumn("benchmark", F.when(odd, fail).otherwise(F.col("benchmark")))


def _series(returns: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    """Per series: size, blocks, point estimates and why it cannot be resampled."""
    active = F.col("strategy") - F.col("benchmark")
    s = returns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("strategy").alias("s_mean"), F.stddev_samp("strategy").alias("s_std"),
        F.avg("benchmark").alias("b_mean"), F.stddev_samp("benchmark").alias("b_std"), F.stddev_samp(active).alias("a_std"))
    length, required = opts.block_length, max(opts.min_observations, MIN_BLOCKS * opts.block_length)
    s = s.withColumn("blocks", F.ceil(F.col("n") / length))
    problem = F.when(F.col("n") < required, "insufficient_data")
    return s.withColumns({"unavailable": problem, "required": F.lit(required)})


def hash_draws(series: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    """Start of every (resample, block), uniform by hash: any task can produce any draw."""
    grid = series.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(opts.n_resamples - 1))).alias("resample"), "blocks")
    # few series make few input rows: spread the resamples before they are expanded into blocks
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = grid.repartition(tasks, *keys, "resample")
    grid = grid.select(*keys, "n", "resample", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    return grid.select(*keys, "resample", "block", F.pmod(uniform_hash(opts.seed, F.col("resample"), F.col("block")), F.col("n")).alias("start"))


def generator_draws(series: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    """The same table from a seeded PCG64 stream, for exact replication.

    Series of one size have the same stream, so it is drawn once for each size and joined to them. A stream can only be drawn in
    order, by one task a size, but it leaves that task a few resamples at a time.
    """
    seed, resamples = opts.seed, opts.n_resamples

    def draw(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for n, blocks in zip(frame["size"].tolist(), frame["blocks"].tolist(), strict=True):
                stream = np.random.Generator(np.random.PCG64(seed))
                step = max(1, 500_000 // blocks)
                for first in range(0, resamples, step):
                    some = np.arange(first, min(resamples, first + step), dtype="int32")
                    starts = stream.integers(0, n, size=(len(some), blocks))
                    yield pd.DataFrame({"size": n, "resample": np.repeat(some, blocks), "block": np.tile(np.arange(blocks, dtype="int32"), len(some)),
                                        "start": starts.reshape(-1)})

    sizes = series.select(F.col("n").alias("size"), F.col("blocks").cast("bigint").alias("blocks")).distinct()
    drawn = sizes.mapInPandas(draw, "size bigint, resample int, block int, start bigint")
    return series.select(*keys, "n").join(drawn, F.col("n") == F.col("size")).select(*keys, "resample", "block", "start")


def _block_sums(returns: DataFrame, series: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    """Sums of the whole and of the shorter last block starting at each row, with wrap-around.

    The first ``block_length`` rows are repeated behind the last one, so that both blocks are plain frames. The shorter one has
    another length in every series, which a frame can't have; over positions divided by that length its end is the same for all.
    Of each column the value at the start and the length of the run of equal values from there are kept as well, so that
    constant resamples are known exactly.
    """
    length = opts.block_length
    w = Window.partitionBy(*keys).orderBy("date")
    df = returns.join(series.filter(F.col("unavailable").isNull()).select(*keys, "n", "blocks", "s_mean", "b_mean"), list(keys))
    df = df.select(*keys, "n", "blocks", (F.row_number().over(w) - 1).cast("bigint").alias("start"),
                   (F.col("strategy") - F.col("s_mean")).alias("x"), (F.col("benchmark") - F.col("b_mean")).alias("y"))
    ring = df.unionByName(df.filter(F.col("start") < length).withColumn("start", F.col("start") + F.col("n")))
    ring = ring.withColumns({"tail": F.col("n") - (F.col("blocks") - 1) * length, "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y")})
    ring = ring.withColumn("_z", F.col("start").cast("double") / F.col("tail"))
    order = Window.partitionBy(*keys).orderBy("start")
    whole, after = order.rowsBetween(0, length - 1), order.rowsBetween(1, Window.unboundedFollowing)
    part = f"over (partition by {', '.join(keys)} order by _z range between current row and {1 - 1 / (2 * length)!r}D following)"
    names = ("x", "xx", "y", "yy")
    ring = ring.withColumns({f"_turn_{c}": F.when(F.col(c) != F.lag(c).over(order), F.col("start")) for c in ("x", "y")})
    ring = ring.withColumns({f"run_{c}": F.coalesce(F.min(f"_turn_{c}").over(after), F.col("n") + length) - F.col("start") for c in ("x", "y")}
                            | {f"f_{c}": F.sum(c).over(whole) for c in names} | {f"l_{c}": F.expr(f"sum({c}) {part}") for c in names})
    return ring.filter(F.col("start") < F.col("n")).drop("_z", "_turn_x", "_turn_y", "xx", "yy")


def resample_statistics(returns: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    """One row per (series, resample) with the five statistics."""
    returns = cut_lineage(returns.select(*keys, "date", "strategy", "benchmark"))
    return _resampled(returns, cut_lineage(_series(returns, keys, opts)), keys, opts)


def _resampled(returns: DataFrame, series: DataFrame, keys, opts: BootstrapOptions) -> DataFrame:
    usable = series.filter(F.col("unavailable").isNull())
    draws = (generator_draws if opts.draws == "pcg64" else hash_draws)(usable, keys, opts)
    sums = _block_sums(returns, series, keys, opts)
    df = draws.join(sums, [*keys, "start"])
    last = F.col("block") == F.col("blocks") - 1
    pick = lambda c: F.sum(F.when(last, F.col(f"l_{c}")).otherwise(F.col(f"f_{c}"))).alias(c)
    size = F.when(last, F.col("tail")).otherwise(F.lit(opts.block_length))
    flat = lambda c: (F.bool_and(F.col(f"run_{c}") >= size) & (F.min(c) == F.max(c))).alias(f"flat_{c}")
    agg = df.groupBy(*keys, "resample").agg(*[pick(c) for c in ("x", "xx", "y", "yy")], flat("x"), flat("y"))
    agg = agg.join(series.select(*keys, "n", "s_mean", "b_mean"), list(keys))
    return agg.select(*keys, "resample", *_five(agg, opts))


def _five(_, opts: BootstrapOptions) -> list[Column]:
    ann, rf, n = opts.annualization, opts.risk_free_rate, F.col("n").cast("double")

    def parts(total, squares, centre):
        mean = F.col(total) / n + F.col(centre)
        var = F.greatest(F.col(squares) - F.col(total) * F.col(total) / n, F.lit(0.0)) / (n - 1)
        std = F.when(F.col(f"flat_{total}"), 0.0).otherwise(F.sqrt(var))
        return mean * ann, F.when(std > MIN_STD, (mean * ann - rf) / (std * ann**0.5))

    s, ss = parts("x", "xx", "s_mean")
    b, bs = parts("y", "yy", "b_mean")
    return [c.alias(name) for name, c in zip(STATISTICS, (s, ss, b, bs, s - b))]


def bootstrap(returns: DataFrame, keys: Sequence[str], opts: BootstrapOptions) -> DataFrame:
    """Estimate, percentile interval and status of each statistic per series.

    ``returns`` has the keys, ``date``, ``strategy`` and ``benchmark``. Undefined
    resamples are never dropped: they make the interval unavailable.
    """
    ann, rf, root = opts.annualization, opts.risk_free_rate, opts.annualization**0.5
    returns = cut_lineage(returns.select(*keys, "date", "strategy", "benchmark"))
    series = cut_lineage(_series(returns, keys, opts))
    low, high = (1 - opts.confidence_level) / 2, (1 + opts.confidence_level) / 2
    samples = _resampled(returns, series, keys, opts)
    spread = samples.groupBy(*keys).agg(*[
        F.struct(F.count(c).alias("valid"), F.min(c).alias("lo"), F.max(c).alias("hi"),
                 F.percentile(c, F.array(F.lit(low), F.lit(high))).alias("q")).alias(c) for c in STATISTICS])
    sharpe = lambda m, s: F.when(F.col(s) > MIN_STD, (F.col(m) * ann - rf) / (F.col(s) * root))
    points = {
        "strategy_annualized_mean": (F.col("s_mean") * ann, "s_std"), "strategy_sharpe": (sharpe("s_mean", "s_std"), "s_std"),
        "benchmark_annualized_mean": (F.col("b_mean") * ann, "b_std"), "benchmark_sharpe": (sharpe("b_mean", "b_std"), "b_std"),
        "annualized_mean_excess": ((F.col("s_mean") - F.col("b_mean")) * ann, "a_std")}
    df = series.join(spread, list(keys), "left")
    empty = F.lit(None)
    rows = F.array(*[
        F.struct(F.lit(c).alias("statistic"), points[c][0].alias("estimate"), F.col(points[c][1]).alias("_std"), F.col(f"{c}.valid").alias("valid_resamples"),
                 F.col(f"{c}.lo").alias("_lo"), F.col(f"{c}.hi").alias("_hi"), F.col(f"{c}.q").alias("_q")) for c in STATISTICS])
    df = df.select(*keys, "n", "required", "unavailable", F.inline(rows))
    flat = F.col("_hi") - F.col("_lo") <= 32 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs("_lo"), F.abs("_hi"))
    status = (
        F.when(F.col("unavailable").isNotNull(), F.col("unavailable"))
        .when(F.col("_std").isNull(), "undefined_statistic").when(F.col("_std") <= MIN_STD, "zero_variance")
        .when(F.col("estimate").isNull(), "undefined_statistic")
        .when(F.col("valid_resamples") != opts.n_resamples, "degenerate_resamples").when(flat, "degenerate_resamples").otherwise("ok"))
    df = df.withColumn("status", status)
    ok = F.col("status") == "ok"
    return df.select(*keys, F.col("n").alias("n_observations"), "required", "statistic", "estimate",
                     F.when(ok, F.get("_q", F.lit(0))).otherwise(empty).alias("ci_low"), F.when(ok, F.get("_q", F.lit(1))).otherwise(empty).alias("ci_high"),
                     F.coalesce("valid_resamples", F.lit(0)).alias("valid_resamples"), "status")


def overall_status(statistics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ok when every statistic is, partial when some are, else unavailable."""
    good = F.col("status") == "ok"
    return statistics.groupBy(*keys).agg(
        F.when(F.bool_and(good), "ok").when(F.bool_or(good), "partial").otherwise("unavailable").alias("status"))
