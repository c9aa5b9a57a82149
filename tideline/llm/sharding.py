"""Shards that match the mixture: proportional stratified interleaving of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bucket_bits, numbered, stage


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
               stratum: str = "source") -> DataFrame:
    """Deal every row of ``docs`` to shards 0 to ``shards`` - 1 so that each shard has the mixture of strata of the whole.

    Rows are shuffled by a seeded hash and ranked within their stratum; rank r of n becomes the position (r + u) / n, where u in
    [0, 1) is a hash of the stratum, so that many small strata don't meet at one position. All rows are sorted by position and
    cut into runs whose lengths differ by one at most (law ``rows``). Equal texts are no unit here: a cut by the mixture would
    have to break either. A stratum misses its share of a
    shard by less than a row at either cut, and by its part of what the roundings of all other strata add up to there.

    Nothing sorts or counts a whole stratum in one task: ranks are numbered within buckets of the hash or the position.

    Returns id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0), grown_shard (null under this law) and
    stratum. A null text counts as no bytes; a null stratum is a stratum of its own; a null id is ordered first. Repeated rows
    are all dealt, in any order among themselves. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    head = docs.select(
        F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    name = F.when(F.col("stratum").isNull(), "n").otherwise(F.concat(F.lit("s"), "stratum"))
    head = head.withColumns({
        "part": name,
        "draw": F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15),
                       16, 10).cast("bigint")})
    head = stage(head, "shard_rows")
    rows = head.count()
    bits = bucket_bits(rows)
    ties = [F.col("draw"), F.col("id").asc_nulls_first(), F.col("crc"), F.col("size")]
    ranked = numbered(head.withColumn("bucket", F.shiftright("draw", 60 - bits)), ["part"], "bucket", ties, "rank", "n")
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), "part")), 1, 13), 16, 10).cast("bigint")
    position = (F.col("rank") + offset.cast("double") / F.lit(float(2 ** 52))) / F.col("n")
    ranked = ranked.withColumn("position", position).withColumn(
        "bucket", F.least(F.floor(F.col("position") * float(2 ** bits)), F.lit(2 ** bits - 1)))
    ranked = stage(ranked.drop("draw", "n", "rank"), "shard_ranks")
    dealt = numbered(ranked, [], "bucket", [F.col("position"), F.col("part")], "g")
    dealt = dealt.withColumn("shard", F.expr(f"(g * {shards}L) div {max(rows, 1)}L").cast("int"))
    first = F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")
    return dealt.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("g") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("stratum"))
