"""Whitening of embeddings on the covariance of their distinct vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage

#: Components beyond this share of the largest eigenvalue have no variance but rounding.
NO_VARIANCE = 1e-13


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``id, x, digest``: whole numbers floor(scale * c) + shift for every vector without null or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint") + F.lit(shift).cast("bigint"))
    rows = kept.select(F.col(id_col).alias("id"), x.alias("x"))
    return rows.withColumn("digest", F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256))


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls and of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _second_moments(rows: DataFrame, width: int, centred) -> DataFrame:
    """``i, j, v``: the upper triangle of the weighted sum of outer products. ``centred(batch)`` gives (rows, weights) of a batch.

    A task adds up its batches and gives one row for each row of the matrix; only those are shuffled.
    """
    def run(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            c, w = centred(batch)
            total += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).where("j >= i")
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _square(cells: DataFrame, width: int) -> np.ndarray:
    """The symmetric matrix of ``cells`` on the driver: width squared numbers, whatever the number of vectors."""
    out = np.zeros((width, width))
    for r in cells.toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def whiten(vectors: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Principal whitening of every row: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors become whole numbers (:func:`quantised`); identical ones are grouped with their count first, so that a vector with a
    third of all rows is one row from then on. ``weights`` says what a distinct vector weighs in the fit: ``one``, or its
    ``count``. Sums are exact; n * x - S is formed in whole numbers before anything is multiplied, tasks add up outer products of
    the centred vectors, and the driver decomposes the one matrix of dimensions squared. Every distinct vector is whitened once
    and joined back to its rows. Signs are fixed by the largest entry of a component.

    n is the weight of the fit list, deviation the exact sum over dimensions of (n * x - S)^2 (an error if it doesn't fit into a
    long), explained the component's share of the trace, identity_error the largest absolute entry of (covariance of the
    whitened fit list - identity).

    Rows with a null or empty vector, or null or non-finite entries are left out; vectors of different lengths, or with entries
    beyond a long, are an error. Repeated rows and null ids are kept as they are. With fewer dimensions than ``components`` there
    are as many components as dimensions. A component without variance (constant dimensions, fewer vectors than dimensions) has a
    null ``whitened`` and is left out of identity_error, which is null if none has any. An empty table gives no rows. Other columns
    are ignored.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be one or count")
    schema = f"id {dict(vectors.dtypes)[id_col]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = stage(quantised(vectors, id_col, vector_col, scale, shift), "white_rows")
    fit = stage(rows.groupBy("digest", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "w", F.lit(1).cast("bigint") if weights == "one" else F.col("copies")).drop("copies"), "white_fit")
    n, least, width = fit.agg(F.sum("w"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if least != width:
        raise ValueError(f"vectors of {least} and of {width} dimensions")
    sums = np.zeros(width, dtype=np.int64)
    for r in fit.select("w", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v")).toLocalIterator():
        sums[r.i] = r.v

    def offsets(batch):  # n * x - S
        return n * _matrix(batch.column(batch.schema.get_field_index("x"))) - sums

    def centred(batch):
        return offsets(batch) / n, np.asarray(batch.column(batch.schema.get_field_index("w"))).astype(float)

    cov = _square(_second_moments(fit, width, centred), width) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    live = values > max(values[0], 0.0) * NO_VARIANCE
    if not trace > 0:
        live[:] = False
    kept = len(values)
    project = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    share = [float(v) / trace if trace > 0 else 0.0 for v in np.maximum(values, 0.0)]

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            d = offsets(batch)
            if d.size and float(np.abs(d).max()) ** 2 * width >= 2.0 ** 62:
                far = pa.array([sum(int(v) ** 2 for v in row) for row in d], pa.int64())
            else:
                far = pa.array((d * d).sum(axis=1), pa.int64())
            yield pa.RecordBatch.from_pydict({
                "digest": batch.column(batch.schema.get_field_index("digest")), "w": batch.column(batch.schema.get_field_index("w")), "deviation": far,
                "z": pa.array(list((d / n) @ project), pa.list_(pa.float64()))})

    white = stage(fit.mapInArrow(score, "digest string, w bigint, deviation bigint, z array<double>"), "white_scores")
    means = white.agg(*[F.sum(F.get("z", F.lit(i)) * F.col("w")) / n for i in range(kept)]).first()
    mean = np.array([float(m) for m in means])
    again = _square(_second_moments(white, kept, lambda b: (
        _matrix(b.column(b.schema.get_field_index("z"))) - mean, np.asarray(b.column(b.schema.get_field_index("w"))).astype(float))), kept) / n
    error = float(np.abs(again - np.eye(kept))[np.ix_(live, live)].max()) if live.any() else None
    alive = F.array(*[F.lit(bool(v)) for v in live])
    out = rows.select("id", "digest").join(white.drop("w"), "digest").select("id", "deviation", F.posexplode("z").alias("_c", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("_c") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(F.get(alive, F.col("_c")), F.col("whitened")).alias("whitened"), F.get(F.array(*[F.lit(v) for v in share]), F.col("_c")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
