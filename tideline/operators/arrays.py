"""Walks over the bars of many candidates at once, without a second shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: candidates that advance together; it bounds what a task holds in numpy
TOGETHER = 256


def over_bars(df: DataFrame, ids: Sequence[str], order: Sequence[str], values: Sequence[str], params: Sequence[str],
              rule: Callable[[Mapping[str, np.ndarray], Mapping[str, np.ndarray]], Mapping[str, np.ndarray]],
              out: Mapping[str, str]) -> DataFrame:
    """Add the columns ``out`` (name to type) that ``rule`` computes along ``order`` within ``ids``.

    The bars of an id become arrays, which the calendar bounds, and go through a scalar pandas function: unlike a grouped one it
    leaves rows where they are, so what was partitioned by a part of ``ids`` stays so. ``rule`` gets float arrays
    (candidates x bars) of ``values`` and arrays of ``params``; candidates with equally many bars advance together.
    """
    first = [*order, *[c for c in df.columns if c not in (*ids, *order, *params)]]
    columns = [*ids, *params]
    grouped = df.groupBy(*ids).agg(*[F.first(p).alias(p) for p in params], F.array_sort(F.collect_list(F.struct(*first))).alias("_bars"))
    schema = ", ".join(f"{name}: array<{kind}>" for name, kind in out.items())

    @F.pandas_udf(f"struct<{schema}>")
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        result = {name: [None] * len(rows) for name in out}
        sizes = rows[values[0]].map(len).to_numpy()
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            for at in range(0, len(same), TOGETHER):
                picked = same[at:at + TOGETHER]
                bars = {v: np.stack([np.asarray(rows[v].iat[i], dtype=float) for i in picked]) for v in values}
                found = rule(bars, {p: rows[p].to_numpy()[picked] for p in params})
                for name, table in found.items():
                    for i, row in zip(picked, table, strict=True):
                        result[name][i] = row
        return pd.DataFrame(result)

    inputs = F.struct(*[_column(v) for v in values], *params)
    done = grouped.withColumn("_out", walk(inputs))
    zipped = F.arrays_zip("_bars", *[F.col(f"_out.{name}").alias(name) for name in out])
    rows = done.select(*columns, F.explode(zipped).alias("_b"))
    return rows.select(*columns, "_b._bars.*", *[F.col(f"_b.{name}").alias(name) for name in out])


def _column(value: str):
    return F.transform("_bars", lambda bar: bar[value].cast("double")).alias(value)
