"""Helpers shared by the corpus operators: durable intermediate tables and bucketed ranking."""

from __future__ import annotations

import uuid
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.session import durable_dir

#: Ranking splits its rows into buckets of about this many rows, but into 2**MAX_BUCKET_BITS at most, so that the table of
#: bucket sizes stays small; beyond that the buckets grow with the input.
BUCKET_ROWS, MAX_BUCKET_BITS = 256, 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{durable_dir(spark).rstrip('/')}/tideline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors then cost no more than the step in hand, and the planner starts from measured sizes without an inherited
    partitioning, so that adaptive execution can split the partitions of hot keys in the joins that follow.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_bits(rows: int) -> int:
    return min(MAX_BUCKET_BITS, max(0, ceil(log2(max(1, rows) / BUCKET_ROWS))))


def numbered(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], number: str, total: str | None = None) -> DataFrame:
    """Number the rows of each key from 0 in (``bucket``, ``order``) without a window over a whole key.

    ``bucket`` must not decrease along the wanted order. Windows run inside (keys, bucket); what stands before a bucket comes
    from a running sum over the bucket sizes. ``total`` names a column for the number of rows of the key.
    """
    sizes = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_size"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_bucket"),
        (F.sum("_size").over(per_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_size").over(per_key).alias("_total"))
    on = F.col(bucket) == F.col("_bucket")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    out = rows.join(sizes, on).withColumn(
        number, F.coalesce("_before", F.lit(0)) + F.row_number().over(inside) - 1)
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_bucket", "_before", "_total", *[f"_k{i}" for i in range(len(keys))])
