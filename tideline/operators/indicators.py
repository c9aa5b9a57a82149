"""Technical indicators as columns per ticker, computed once and shared by every candidate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k

EPS = k.EPS


def with_moving_averages(df: DataFrame, specs: Iterable[tuple[str, int, str]], source: str = "close",
                         keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """``specs`` are ``(kind, period, output)`` with kind sma, ema, wma or dema."""
    specs = list(dict.fromkeys(specs))
    unknown = {s[0] for s in specs} - {"sma", "ema", "wma", "dema"}
    if unknown:
        raise ValueError(f"unknown moving-average kind: {sorted(unknown)}")
    df = k.with_sequence(df, keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    plain = {}
    for kind, period, out in specs:
        if kind == "sma":
            plain[out] = k.sma(source, period, w)
        elif kind == "wma":
            plain[out] = k.wma(source, period, w)
    if plain:
        df = df.withColumns(plain)
    first = {p: f"_ema1_{p}" for kind, p, _ in specs if kind in ("ema", "dema")}
    if first:
        df = k.with_ewm(df, [(source, k.span_alpha(p), c) for p, c in first.items()], keys)
        second = {p: f"_ema2_{p}" for kind, p, _ in specs if kind == "dema"}
        if second:
            df = k.with_ewm(df, [(first[p], k.span_alpha(p), c) for p, c in second.items()], keys)
        df = df.withColumns({
            out: F.col(first[p]) if kind == "ema" else 2 * F.col(first[p]) - F.col(second[p])
            for kind, p, out in specs if kind in ("ema", "dema")
        })
        df = df.drop(*first.values(), *second.values())
    return df


def true_range(w, high="high", low="low", close="close") -> Column:
    h, l, c1 = F.col(high), F.col(low), F.lag(close).over(w)
    return F.greatest(h - l, F.abs(h - c1), F.abs(l - c1))


def with_atr(df: DataFrame, specs: Iterable[tuple[str, int, str]], keys=("ticker",)) -> DataFrame:
    """``specs`` are ``(kind, period, output)`` with kind sma or wilder."""
    specs = list(specs)
    df = k.with_sequence(df, keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    df = df.withColumn("_tr", true_range(w))
    plain = {o: k.sma("_tr", p, w) for kind, p, o in specs if kind == "sma"}
    df = df.withColumns(plain) if plain else df
    wilder = [("_tr", k.wilder_alpha(p), o) for kind, p, o in specs if kind == "wilder"]
    df = k.with_ewm(df, wilder, keys) if wilder else df
    return df.drop("_tr")


def rsi(period: int, w, delta="_delta") -> Column:
    d = F.col(delta)
    up = k.full_frame(F.avg, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), period, w)
    down = k.full_frame(F.avg, F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), period, w)
    return 100 - 100 / (1 + up / (down + EPS))


def with_rsi(df: DataFrame, periods: Iterable[int], prefix: str = "rsi_", keys=("ticker",)) -> DataFrame:
    df = k.with_sequence(df, keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    df = df.withColumn("_delta", k.difference("close", 1, w))
    return df.withColumns({f"{prefix}{p}": rsi(p, w) for p in periods}).drop("_delta")


def zscore(x: str, period: int, w) -> Column:
    return (F.col(x) - k.sma(x, period, w)) / (k.rolling_std(x, period, w) + EPS)


def volatility(ret: str, period: int, w, ann="ann") -> Column:
    return k.rolling_std(ret, period, w) * F.sqrt(k.as_col(ann))


def bollinger(x: str, period: int, num_std: float, w) -> dict[str, Column]:
    mean, std = k.sma(x, period, w), k.rolling_std(x, period, w)
    upper, lower = mean + num_std * std, mean - num_std * std
    return {"upper": upper, "lower": lower, "bandwidth": (upper - lower) / (mean + EPS)}


def with_macd(df: DataFrame, fast: int, slow: int, signals: Iterable[int], prefix: str, keys=("ticker",)) -> DataFrame:
    """``{prefix}line`` and ``{prefix}signal_{n}`` for each signal span."""
    line = f"{prefix}line"
    df = with_moving_averages(df, [("ema", fast, "_mf"), ("ema", slow, "_ms")], keys=keys)
    df = df.withColumn(line, F.col("_mf") - F.col("_ms")).drop("_mf", "_ms")
    return k.with_ewm(df, [(line, k.span_alpha(s), f"{prefix}signal_{s}") for s in signals], keys)


def with_adx(df: DataFrame, period: int = 14, out: str = "adx", keys=("ticker",)) -> DataFrame:
    df = k.with_sequence(df, keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    df = df.withColumns({"_up": up, "_down": down, "_tr": true_range(w)})
    df = df.withColumns({
        "_pdm": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_ndm": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0),
    })
    a = k.wilder_alpha(period)
    df = k.with_ewm(df, [("_tr", a, "_atr"), ("_pdm", a, "_p"), ("_ndm", a, "_n")], keys)
    pdi, ndi = 100 * F.col("_p") / (F.col("_atr") + EPS), 100 * F.col("_n") / (F.col("_atr") + EPS)
    df = df.withColumns({"_pdi": pdi, "_ndi": ndi})
    df = df.withColumn("_dx", 100 * F.abs(F.col("_pdi") - F.col("_ndi")) / (F.col("_pdi") + F.col("_ndi") + EPS))
    df = k.with_ewm(df, [("_dx", a, out)], keys)
    return df.drop("_up", "_down", "_tr", "_pdm", "_ndm", "_atr", "_p", "_n", "_pdi", "_ndi", "_dx")


def with_heikin_ashi(df: DataFrame, keys=("ticker",)) -> DataFrame:
    df = k.with_sequence(df, keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    df = df.withColumn("ha_close", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    seed = (F.col("open") + F.col("close")) / 2
    df = df.withColumn("_prev", F.coalesce(F.lag("ha_close").over(w), seed))
    return k.with_ewm(df, [("_prev", 0.5, "ha_open")], keys).drop("_prev")
