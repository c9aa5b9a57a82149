"""Passages that repeat across documents: overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage

WINDOW = 3


def _own(name: str) -> str:
    """A column name that no table brings along."""
    return f"__tideline_{name}"


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                        counts: tuple[str, str] = ("_lines", "_removed")) -> DataFrame:
    """``docs`` with later occurrences of every run of ``window`` consecutive lines removed, and the ``counts`` of lines and removed lines.

    Lines end at a line feed and are compared as they are. Of equal windows the first by (id, position) stays; every line that
    a later one covers goes, so overlapping windows remove the union of what they cover. For each line removed an equal line
    stays further up. Texts of fewer lines have no window and stay as they are, as do null texts; an empty text is one empty
    line. Rows that share id and text count as one document, which is compared with others only; null ids come first. All
    columns stay, but for ones named like ``counts``; an empty table stays empty.

    Windows travel as two 64-bit hashes with id and position. Counting them combines before the shuffle; the windows meet the
    repeated hashes again in a join of two stored tables, in which a window with a third of all rows can be split.
    """
    lines = F.split(F.col("_text"), "\n", -1)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")

    def hashes(part):
        return F.struct(F.xxhash64(F.array_join(part, "\n")).alias("h0"), F.xxhash64(F.lit(1), part).alias("h1"))

    def all_windows(ls):
        return F.when(F.size(ls) >= window, F.transform(F.sequence(F.lit(0), F.size(ls) - window), lambda i: hashes(F.slice(ls, i + 1, window))))

    # the lines are bound to a variable of a lambda, so that they are split once for each text
    slim = slim.select("_id", F.xxhash64("_text").alias("_th"), F.posexplode(F.transform(F.array(lines), all_windows)[0]).alias("_pos", "_h"))
    windows = stage(slim.select("_id", "_th", "_pos", "_h.h0", "_h.h1"), "windows")
    place = F.struct(F.col("_id").isNotNull().alias("o"), F.col("_id"), F.col("_th"), F.col("_pos"))
    repeated = windows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stage(repeated.select(F.col("h0").alias("r0"), F.col("h1").alias("r1"), "first"), "repeated_windows")
    later = windows.join(repeated, (F.col("h0") == F.col("r0")) & (F.col("h1") == F.col("r1"))).where(place > F.col("first"))
    starts = later.groupBy("_id", "_th").agg(F.array_sort(F.collect_set("_pos")).alias("_starts"))
    starts = stage(starts, "later_windows").withColumnsRenamed({"_id": _own("id"), "_th": _own("hash"), "_starts": _own("starts")})

    text = F.col(text_col).cast("string")
    # always by shuffle: what is removed grows with the corpus, so this is the plan that a large one needs
    on = F.col(id_col).eqNullSafe(F.col(_own("id"))) & (F.xxhash64(text) == F.col(_own("hash")))
    joined = docs.drop(*counts).join(starts.hint("merge"), on, "left")
    count = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)

    def kept(ls):
        """The runs of lines before, between and after the covered stretches."""
        s = F.col(_own("starts"))
        end = lambda i: F.coalesce(F.get(s, i + 1), F.size(ls))
        run = lambda i: F.slice(ls, F.get(s, i) + window + 1, F.greatest(F.lit(0), end(i) - F.get(s, i) - window))
        return F.concat(F.slice(ls, F.lit(1), F.get(s, F.lit(0))), F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), run)))

    left = F.transform(F.array(F.split(text, "\n", -1)), kept)[0]
    both = F.when(F.col(_own("starts")).isNotNull(), F.transform(F.array(left), lambda x: F.struct(F.array_join(x, "\n").alias("t"), F.size(x).alias("n")))[0])
    joined = joined.withColumn(_own("left"), both)
    out = [F.coalesce(F.col(f"{_own('left')}.t"), text).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts]
    removed = F.when(F.col(_own("left")).isNull(), 0).otherwise(count - F.col(f"{_own('left')}.n"))
    return joined.select(*out, count.cast("bigint").alias(counts[0]), removed.cast("bigint").alias(counts[1]))
