"""The 55-column feature table of the walk-forward classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..sources.bars import with_price_fallback
from .indicators import EPS, rsi, with_moving_averages

# horizons of each family (fixed values)
RETURNS = (1, 3, 5, 10, 21, 42, 63, 126, 252)
MA_DISTANCE = (5, 10, 20, 50, 100, 200)
RSI = (7, 14, 21, 28)
MACD = ((8, 21), (12, 26), (16, 35))
MACD_SIGNAL = (5, 9, 12)
VOLATILITY = (10, 21, 42, 63)
BANDS = (10, 20, 50)
BAND_WIDTHS = (1.5, 2.0, 2.5)
ROC = (5, 10, 21, 42, 63, 126, 252)
VOLUME = (5, 10, 21)
RANGE = (10, 21, 55)


def band_name(period: int, width: float) -> str:
    return f"bb_pos_{period}_{str(width).replace('.', '_')}"


def feature_names() -> list[str]:
    return (
        [f"ret_{p}" for p in RETURNS] + [f"ma_dist_{p}" for p in MA_DISTANCE] + [f"rsi_{p}" for p in RSI]
        + [f"macd_{f}_{s}_{g}" for f, s in MACD for g in MACD_SIGNAL] + [f"vol_{p}" for p in VOLATILITY]
        + [band_name(p, n) for p in BANDS for n in BAND_WIDTHS] + [f"roc_{p}" for p in ROC]
        + [f"vol_ratio_{p}" for p in VOLUME] + ["acceleration"] + [f"range_{p}" for p in RANGE]
    )


def compute_features(bars: DataFrame, keys=("ticker",), keep=()) -> DataFrame:
    """Keys, date, ``keep`` and the 55 features; ``ann`` must be a column of ``bars``.

    One shuffle on the keys; every family is a set of trailing frames over the
    same ordering, the six EMAs share one pass and the nine signal lines another.
    """
    df = with_price_fallback(bars)
    vol = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in df.columns else F.lit(1.0)
    df = k.with_sequence(df.withColumn("_vol", vol), keys)
    w = k.over_time(keys, k.RECURSION_ORDER)
    c = F.col("close")
    df = df.withColumns({"_r": k.simple_return("close", 1, w), "_delta": k.difference("close", 1, w)})
    cols = {}
    for p in RETURNS:
        cols[f"ret_{p}"] = F.col("_r") if p == 1 else k.simple_return("close", p, w)
    for p in sorted({*MA_DISTANCE, *BANDS}):
        cols[f"_sma_{p}"] = k.sma("close", p, w)
    for p in BANDS:
        cols[f"_std_{p}"] = k.rolling_std("close", p, w)
    for p in RSI:
        cols[f"rsi_{p}"] = rsi(p, w)
    for p in VOLATILITY:
        cols[f"vol_{p}"] = k.rolling_std("_r", p, w) * F.sqrt("ann")
    for p in VOLUME:
        cols[f"vol_ratio_{p}"] = F.col("_vol") / (k.sma("_vol", p, w) + EPS)
    for p in RANGE:
        cols[f"range_{p}"] = (k.rolling_max("high", p, w) - k.rolling_min("low", p, w)) / c
    for p in ROC:
        cols[f"roc_{p}"] = (c / F.lag("close", p).over(w) - 1) * 100
    df = df.withColumns(cols)
    df = df.withColumns({f"ma_dist_{p}": (c - F.col(f"_sma_{p}")) / F.col(f"_sma_{p}") for p in MA_DISTANCE})
    bands = {}
    for p in BANDS:
        for n in BAND_WIDTHS:
            upper = F.col(f"_sma_{p}") + n * F.col(f"_std_{p}")
            lower = F.col(f"_sma_{p}") - n * F.col(f"_std_{p}")
            bands[band_name(p, n)] = (c - lower) / (upper - lower + EPS)
    df = df.withColumns(bands).withColumn("acceleration", F.col("ret_5") - F.col("ret_10"))
    spans = sorted({x for pair in MACD for x in pair})
    df = with_moving_averages(df, [("ema", p, f"_e_{p}") for p in spans], keys=keys)
    df = df.withColumns({f"_line_{f}_{s}": F.col(f"_e_{f}") - F.col(f"_e_{s}") for f, s in MACD})
    df = k.with_ewm(df, [(f"_line_{f}_{s}", k.span_alpha(g), f"_sig_{f}_{s}_{g}") for f, s in MACD for g in MACD_SIGNAL], keys)
    df = df.withColumns({f"macd_{f}_{s}_{g}": F.col(f"_line_{f}_{s}") - F.col(f"_sig_{f}_{s}_{g}")
                         for f, s in MACD for g in MACD_SIGNAL})
    return df.select(*keys, "date", *keep, *feature_names())
