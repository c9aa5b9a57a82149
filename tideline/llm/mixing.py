"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import BUCKET_ROWS, MAX_BUCKET_BITS, numbered, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps and rounds of repair that are planned together before their result is written.
CHAIN = 3


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``id, part, source, z, draw``: words of the text, a key of the source that keeps null apart, and a seeded draw of 60 bits."""
    source = F.col(source_col).cast("string")
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("part"), source.alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("z"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint").alias("draw"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``part, s, target`` for a table (part, source, s) with one row per source.

    Sources in code point order, null last, take the weights in turn and share the sum of all ``s`` by them. A target stops at
    ``most`` times its source's size; what is over is shared again by weight among the rest until none is above. The ranks come
    from range partitions, so that no task holds all sources; a round of sharing sends two sums to the driver.
    """
    ranged = stage(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "mix_sources")
    ranked = numbered(ranged, [], "_range", [F.col("source").asc_nulls_last()], "_rank")
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    shares = stage(ranked.select("part", "s", weight.alias("w"), (F.col("s") * most).alias("cap")), "mix_weights")
    total = shares.agg(F.sum("s")).first()[0] or 0
    level, at_cap = None, 0
    while True:
        over = F.lit(False) if level is None else F.col("cap") * level[1] < F.col("w") * level[0]
        n, caps, w = shares.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        if level is not None and n == at_cap or not w:
            break
        level, at_cap = (total - caps, w), n
    if level is None:
        return shares.select("part", "s", F.lit(0.0).alias("target"))
    free = F.lit(float(level[0])) * F.col("w").cast("double") / F.lit(float(level[1]))
    return shares.select("part", "s", F.when(F.col("cap") * level[1] < F.col("w") * level[0], F.col("cap").cast("double")).otherwise(free).alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, most: int = 3, tolerance: float = 1e-11, rounds: int = 40) -> DataFrame:
    """``part, tilt``: the dual solution of entropy balancing, by Newton iterations over grouped sums.

    ``sizes`` is (part, z, n): n documents of z words. The rates r in [0, most] nearest to 1 in relative entropy whose words
    r * z add up to the target are r = min(most, exp(tilt * z)). A step sums words and their derivative over (part), a Newton step
    on the logarithm of the sum follows, kept inside a bracket that every step narrows. Sums are of decimals, so that they do
    not depend on the order of the rows. A source at its cap has no finite tilt: null.
    """
    at_cap = F.col("target") >= F.col("s") * most
    ends = sizes.groupBy("part").agg(F.min("z").alias("z0"))
    gap = F.log(F.col("target") / F.col("s")) / F.col("z0")
    state = targets.join(ends, "part").where((F.col("s") > 0) & ~at_cap).select(
        "part", "target", F.lit(0.0).alias("tilt"), F.least(gap, F.lit(0.0)).alias("lo"),
        F.when(gap > 0, F.lit(log(most)) / F.col("z0")).otherwise(0.0).alias("hi"), F.lit(False).alias("done"))
    state = stage(state, "mix_state")
    for k in range(rounds):
        state = _newton(sizes, state, most, tolerance)
        if k % CHAIN == CHAIN - 1:
            state = stage(state, "mix_state")
            if not state.where("not done").head(1):
                return state.select("part", "tilt")
    raise RuntimeError("entropy balancing did not settle")


def _newton(sizes: DataFrame, state: DataFrame, most: int, tolerance: float) -> DataFrame:
    rows = sizes.join(state, "part")
    words = F.col("n").cast("double") * F.col("z") * F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("z")))
    slope = F.when(F.exp(F.col("tilt") * F.col("z")) < most, words * F.col("z")).otherwise(0.0)
    sums = rows.groupBy("part", "target", "tilt", "lo", "hi", "done").agg(
        F.sum(words.cast("decimal(28,12)")).cast("double").alias("g"), F.sum(slope.cast("decimal(34,8)")).cast("double").alias("d"))
    sums = sums.withColumns({"lo": F.when(F.col("g") < F.col("target"), F.col("tilt")).otherwise(F.col("lo")),
                             "hi": F.when(F.col("g") > F.col("target"), F.col("tilt")).otherwise(F.col("hi"))})
    step = F.when((F.col("g") > 0) & (F.col("d") > 0), F.col("tilt") - F.log(F.col("g") / F.col("target")) * F.col("g") / F.col("d"))
    inside = (step >= F.col("lo")) & (step <= F.col("hi"))
    near = F.abs(F.col("g") - F.col("target")) <= F.col("target") * tolerance
    narrow = F.col("hi") - F.col("lo") <= F.greatest(F.abs("lo"), F.abs("hi")) * 4e-16
    return sums.select(
        "part", "target", F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"),
        "lo", "hi", (F.col("done") | near | narrow).alias("done"))


def whole_copies(sizes: DataFrame, targets: DataFrame, tilts: DataFrame, most: int = 3) -> DataFrame:
    """``part, z, n, k``: how many copies all n documents of z words get together.

    The rates' running sum from the longest size down is rounded at every size: the words miss the target by half a longest document
    at most. The rest is mended by further copies (or by taking some back) from the longest size that fits into it down; a
    round at least halves it, until no document that could change is short enough. A window of one source holds one row for
    every different size, whatever its number of documents.
    """
    down = Window.partitionBy("part").orderBy(F.col("z").desc())
    whole = Window.partitionBy("part")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("z"))))
    rows = sizes.join(targets, "part").join(tilts, "part", "left")
    rows = rows.withColumn("_c", F.floor(F.sum((F.col("n") * rate).cast("decimal(28,9)")).over(upto) + F.lit(0.5).cast("decimal(2,1)")))
    k = F.col("_c") - F.coalesce(F.lag("_c").over(down), F.lit(0))
    rows = rows.select("part", "z", "n", F.greatest(F.lit(0), F.least(k, F.col("n") * most)).cast("bigint").alias("k"),
                       F.round("target").cast("bigint").alias("want"), F.lit(0).cast("bigint").alias("q"))
    while True:
        for _ in range(CHAIN):
            rows = rows.withColumn("_e", F.col("want") - F.sum(F.col("k") * F.col("z")).over(whole))
            rows = rows.withColumn("_free", F.when(F.col("z") > F.abs("_e"), 0).when(F.col("_e") > 0, F.col("n") * most - F.col("k")).otherwise(F.col("k")))
            rows = rows.withColumn("_left", F.abs("_e") - F.sum(F.col("_free") * F.col("z")).over(upto) + F.col("_free") * F.col("z"))
            q = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_free"), F.expr("_left div z")))
            rows = rows.withColumn("q", q).withColumn("k", F.col("k") + F.when(F.col("_e") > 0, F.col("q")).otherwise(-F.col("q")))
            rows = rows.drop("_e", "_free", "_left")
        rows = stage(rows, "mix_copies")
        if not rows.where("q > 0").head(1):
            return rows.select("part", "z", "n", "k")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """How often each row of ``docs`` enters the mixture: id, size, source_size, target, taken, copies.

    Size is the number of words of the text (null: 0). Sources share all words by ``weights`` (see :func:`source_targets`); the
    rates of their documents are tilted exponentially in the size until the expected words meet the target (:func:`balance`), and
    rounded into 0 to ``most`` whole copies (:func:`whole_copies`). Of equally long documents of a source the ones with the least
    seeded draws of the id get the odd copies. ``taken`` is copies times size. Reruns agree whatever the partitioning.

    Documents meet their source's sums as (source, size) counts, so that a source with a third of all rows is aggregated before
    it is shuffled; ranks come from windows over hash buckets of one size. Null texts and texts without words take nothing; a
    null source is a source of its own, the last; a null id draws like an empty one; repeated rows draw alike and are told apart
    in any order. A text of any length is counted whole. An empty table gives no rows. Other columns are ignored.
    """
    rows = stage(measured(docs, id_col, text_col, source_col, seed), "mix_rows")
    sizes = stage(rows.groupBy("part", "source", "z").agg(F.count(F.lit(1)).alias("n")), "mix_sizes")
    targets = stage(source_targets(sizes.groupBy("part", "source").agg(F.sum(F.col("z") * F.col("n")).alias("s")), weights, most), "mix_targets")
    some = sizes.where("z > 0").select("part", "z", "n")
    copies = whole_copies(some, targets, balance(some, targets, most), most)
    groups = sizes.select("part", "z", "n").join(copies.drop("n"), ["part", "z"], "left").join(targets, "part")
    bits = F.least(F.lit(MAX_BUCKET_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET_ROWS)))))).cast("int")
    # sixty bits of draw: the bucket is its first few, none for a small group
    groups = stage(groups.select("part", "z", F.coalesce("k", F.lit(0)).alias("k"), F.col("n").alias("_n"), "s", "target", (F.lit(60) - bits).alias("_shift")), "mix_groups")
    dealt = rows.drop("source").join(groups, ["part", "z"]).withColumn("bucket", F.expr("shiftright(draw, _shift)"))
    dealt = stage(dealt.select("id", "part", "z", "draw", "k", "_n", "s", "target", "bucket"), "mix_dealt")
    ranked = numbered(dealt, ["part", "z"], "bucket", [F.col("draw"), F.col("id").asc_nulls_first()], "rank")
    taken = F.expr("k div _n + if(rank < k % _n, 1, 0)")
    return ranked.select(F.col("id").alias(id_col), F.col("z").alias("size"), F.col("s").alias("source_size"), "target",
                         (taken * F.col("z")).cast("bigint").alias("taken"), F.when(F.col("z") > 0, taken).otherwise(0).cast("int").alias("copies"))
