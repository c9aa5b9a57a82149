"""Time-series kernels as window columns over ``keys`` ordered by ``date``.

A group of one ticker (or one ticker and candidate) holds at most one row per
calendar day, so a window partition is bounded by the length of the calendar,
never by the size of the raw feed the bars were aggregated from.

Warm-up is always NULL. NaN never appears: Spark orders NaN above every number,
which would turn an unknown signal into a long position.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows per block of the exponential recursion; decay**-63 stays far inside binary64
EWM_BLOCK = 64
EWM_CHAPTER = 64 * EWM_BLOCK
#: Weight below which an exponential mean leaves earlier chapters out.
NEGLIGIBLE = 1e-60
#: Order of time inside a key for operators that use recursion blocks.
RECURSION_ORDER = ("_chap", "_blk", "_seq")
EPS = 1e-10


def over_time(keys: Sequence[str] = ("ticker",), order="date") -> Window:
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(window, period: int, shift: int = 0):
    """The ``period`` rows that end ``shift`` rows before the current one."""
    return window.rowsBetween(-(period - 1 + shift), -shift)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shifted(x, k: int, window) -> Column:
    x = as_col(x)
    if k == 0:
        return x
    return F.lag(x, k).over(window) if k > 0 else F.lead(x, -k).over(window)


def simple_return(x, period: int, window, shift: int = 0) -> Column:
    """``x[t-shift] / x[t-shift-period] - 1``."""
    return shifted(x, shift, window) / F.lag(as_col(x), shift + period).over(window) - 1


def difference(x, period: int, window) -> Column:
    return as_col(x) - F.lag(as_col(x), period).over(window)


def full_frame(agg, x, period: int, window, shift: int = 0) -> Column:
    """``agg(x)`` over a trailing frame, NULL until all ``period`` values are known."""
    x = as_col(x)
    frame = trailing(window, period, shift)
    return F.when(F.count(x).over(frame) == period, agg(x).over(frame))


def sma(x, period: int, window) -> Column:
    return full_frame(F.avg, x, period, window)


def rolling_std(x, period: int, window) -> Column:
    return full_frame(F.stddev_samp, x, period, window)


def rolling_max(x, period: int, window, shift: int = 0) -> Column:
    return full_frame(F.max, x, period, window, shift)


def rolling_min(x, period: int, window, shift: int = 0) -> Column:
    return full_frame(F.min, x, period, window, shift)


def confirmed(flag: Column, n: int, window) -> Column:
    """True when ``flag`` held on each of the last ``n`` rows (unknown counts as false)."""
    flag = F.coalesce(flag, F.lit(False))
    if n <= 1:
        return flag
    frame = trailing(window, n)
    return F.sum(flag.cast("int")).over(frame) >= n


def wma(x, period: int, window, ordinal="_seq") -> Column:
    """Linear weights 1..period, newest heaviest, from two trailing sums.

    With ``i`` the row ordinal, the weight of row ``j`` in the frame ending at
    ``i`` is ``j - (i - period)``, so no array of the frame is ever built.
    """
    x = as_col(x)
    if period <= 1:
        return x
    seq = as_col(ordinal)
    frame = trailing(window, period)
    total = F.sum(x).over(frame)
    ramp = F.sum(seq * x).over(frame) - (seq - period) * total
    return F.when(F.count(x).over(frame) == period, ramp / (period * (period + 1) / 2.0))


def forward_fill(x, window) -> Column:
    return F.last(as_col(x), ignorenulls=True).over(running(window))


def clip(x, low, high) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def vol_scale(ret, period: int, vol_target: float, annualization, window) -> Column:
    """Multiplier that targets an annualised volatility; 0 while it is unknown."""
    realised = rolling_std(ret, period, window) * F.sqrt(as_col(annualization))
    return F.coalesce(F.lit(float(vol_target)) / (realised + EPS), F.lit(0.0))


def growth(ret, window) -> Column:
    """Running product of ``1 + ret``; 0 from the first total loss onwards."""
    ret = as_col(ret)
    ruined = F.max((ret <= -1).cast("int")).over(running(window)) == 1
    logs = F.sum(F.when(ret > -1, F.log1p(ret))).over(running(window))
    return F.when(ruined, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))


def running_peak(x, window, floor: float = 1.0) -> Column:
    return F.greatest(F.max(as_col(x)).over(running(window)), F.lit(floor))


def span_alpha(span: float) -> float:
    return 2.0 / (float(span) + 1.0)


def wilder_alpha(period: float) -> float:
    return 1.0 / float(period)


def with_sequence(df: DataFrame, keys: Sequence[str] = ("ticker",), order="date") -> DataFrame:
    """Add the 0-based ordinal ``_seq``, its recursion block ``_blk`` and its chapter of blocks ``_chap``."""
    if "_seq" not in df.columns:
        df = df.withColumn("_seq", F.row_number().over(over_time(keys, order)) - 1)
    if "_blk" not in df.columns:
        df = df.withColumn("_blk", (F.col("_seq") / EWM_BLOCK).cast("int"))
    if "_chap" not in df.columns:
        df = df.withColumn("_chap", (F.col("_seq") / EWM_CHAPTER).cast("int"))
    return df


def _decayed_sum(factor: float):
    return lambda acc, v: acc * F.lit(factor) + v


def _short_memory(source: str, alpha: float, keys: Sequence[str]):
    """The mean for an alpha so near 1 that rows six or more steps back are below the last bit; alpha 1 is the source itself."""
    if alpha >= 1.0:
        return F.col(source)
    w = over_time(keys, RECURSION_ORDER)
    seed = F.first(source, ignorenulls=True).over(running(w))
    terms = [alpha * (1.0 - alpha) ** j * F.coalesce(F.lag(F.col(source), j).over(w) - seed, F.lit(0.0)) for j in range(6)]
    return F.when(F.col(source).isNotNull(), seed + sum(terms[1:], terms[0]))


def with_ewm(df: DataFrame, specs: Iterable[tuple[str, float, str]], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add exponentially weighted means ``(source, alpha, output)``, all in one pass.

    ``e[t] = (1-alpha) e[t-1] + alpha x[t]``, seeded with the first known value;
    the source may start with NULLs but has none later. The recursion is linear,
    so it is unrolled in three layers: a running sum of rescaled deviations
    inside a block of 64 rows; the ends of the at most 63 blocks before it in
    its chapter of 64 blocks, folded once per block; and the state at the end
    of the chapter before, a scan over chapter ends whose reach doubles until
    what lies beyond it weighs less than 1e-60 (no doubling at all for spans up
    to 59). Nothing is collected over more than a chapter, so the cost of a row
    depends neither on the span nor on the length of the series. All windows
    share one ordering (keys, chapter, block, ordinal), so Spark sorts once.
    """
    specs = list(specs)
    df = with_sequence(df, keys)
    moving = [(s, float(a), o) for s, a, o in specs if a <= 0.9999]
    copies = {o: _short_memory(s, float(a), keys) for s, a, o in specs if a > 0.9999}
    if any(not 0.0 < a <= 1.0 for _, a, _ in specs):
        raise ValueError("alpha must be in (0, 1]")
    if moving:
        by_key = over_time(keys, RECURSION_ORDER)
        in_chapter = Window.partitionBy(*keys, "_chap").orderBy("_blk", "_seq")
        in_block = running(Window.partitionBy(*keys, "_chap", "_blk").orderBy("_seq"))
        slot = F.col("_seq") - F.col("_blk") * EWM_BLOCK
        page = F.col("_seq") - F.col("_chap") * EWM_CHAPTER
        seeds = {f"_seed_{s}": F.first(s, ignorenulls=True).over(running(by_key)) for s in {m[0] for m in moving}}
        df = df.withColumns(seeds)
        part, folds, state, end, final = {}, {}, {}, {}, {}
        for s, alpha, o in moving:
            decay = 1.0 - alpha
            term = F.lit(alpha) * (F.col(s) - F.col(f"_seed_{s}")) * F.pow(F.lit(decay), -slot)
            part[f"_part_{o}"] = F.coalesce(F.sum(term).over(in_block), F.lit(0.0)) * F.pow(F.lit(decay), slot)
            ends = F.collect_list(F.when(slot == EWM_BLOCK - 1, F.col(f"_part_{o}"))).over(running(in_chapter))
            fold = F.aggregate(ends, F.lit(0.0), _decayed_sum(decay**EWM_BLOCK))
            folds[f"_fold_{o}"] = F.when((slot == 0) | (page == EWM_CHAPTER - 1), fold)
            state[f"_state_{o}"] = F.when(slot == 0, F.col(f"_fold_{o}"))
            end[f"_end_{o}"] = F.when(page == EWM_CHAPTER - 1, F.col(f"_fold_{o}"))
            carried = F.last(f"_state_{o}", ignorenulls=True).over(running(by_key))
            inherited = F.last(f"_end_{o}", ignorenulls=True).over(before(by_key))
            final[o] = F.when(
                F.col(s).isNotNull(),
                F.col(f"_seed_{s}") + F.col(f"_part_{o}") + F.pow(F.lit(decay), slot + 1) * carried
                + F.coalesce(F.pow(F.lit(decay), page + 1) * inherited, F.lit(0.0)),
            )
        df = df.withColumns(part).withColumns(folds).withColumns({**state, **end})
        reach = EWM_CHAPTER
        while wide := [(o, (1.0 - a) ** reach) for _, a, o in moving if (1.0 - a) ** reach >= NEGLIGIBLE]:
            earlier = {o: F.coalesce(F.lag(f"_end_{o}", reach).over(by_key), F.lit(0.0)) for o, _ in wide}
            df = df.withColumns({f"_end_{o}": F.col(f"_end_{o}") + weight * earlier[o] for o, weight in wide})
            reach *= 2
        df = df.withColumns(final)
        df = df.drop(*seeds, *part, *folds, *state, *end)
    return df.withColumns(copies) if copies else df
