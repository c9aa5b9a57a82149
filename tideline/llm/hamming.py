"""Exact nearest binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stage

BITS = 64
#: What one lookup in the shuffled index costs, in entries of that index.
LOOKUP_COST = 4
#: Codes that a task indexes at once, and queries that it asks of them; blocks searched after the first one are so many times those before.
CODE_BLOCK, QUERY_BLOCK, GROWTH = 1 << 20, 1 << 16, 4
#: Inside a task: queries searched together, lookups and pairs held at once.
TOGETHER, LOOKUPS, PAIRS = 512, 1 << 16, 1 << 18


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, code``: bit i of the 64-bit code says whether component i is above 0; missing components are not.

    A code has 64 bits: a vector with more components ends the job with an error.
    """
    bits = [F.when(F.get(F.col(vector_col), F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    fits = F.size(vector_col) <= BITS
    code = F.when(fits, code).otherwise(F.raise_error(F.concat(F.lit(f"sign_codes takes vectors of at most {BITS} components, this one has "), F.size(vector_col))).cast("bigint"))
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code.alias("code"))


def _segments(code, count: int, width: list[int]):
    out, shift = [], 0
    for w in width:
        out.append(F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << w) - 1)))
        shift += w
    return out


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` codes nearest to every query: query_id, neighbour_id, distance, rank (from 1; ties by id).

    ``codes`` and ``queries`` have id and code. Every neighbour is found by looking up segment values within a search radius that
    grows until the kth verified distance is covered, first in an index over all codes, then in one for each block of codes.

    The index over all codes cuts them into as many segments as make a segment's values about as many as there are distinct
    codes. In round t every open query looks up, for each segment, all values at most t bits away. Two codes at most
    segments * (t + 1) - 1 bits apart have a segment at most t bits apart, so this covers that radius; a query whose kth verified
    distance is within it is done. A round verifies each pair once (at the first segment that finds it) and keeps distances that
    earlier rounds didn't cover. These lookups cross the shuffle, so once those of the next round, ``LOOKUP_COST`` each, outnumber
    the entries of the index, the queries still open go on in blocks (:class:`BlockIndex`), whose lookups stay in a task: what is
    shuffled for a round never exceeds the index itself. The blocks are searched a few at first, then more and more; what a query
    has found in earlier ones bounds the distance it asks of the later ones.

    Equal codes are one entry with its ``k`` least ids, which is all that ties by id can need. A row never is its own neighbour;
    rows with the same id count as one if their codes are equal. Rows with a null id or code are left out. Fewer than ``k``
    other rows give fewer neighbours. An empty table gives no rows.
    """
    rows = codes.where("id is not null and code is not null").select("id", "code").distinct()
    least = Window.partitionBy("code").orderBy("id")
    # k + 1: a query that is one of them doesn't count
    entries = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("id", "code")
    entries = stage(entries, "entries")
    book = stage(entries.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = stage(queries.where("id is not null and code is not null").select(F.col("id").alias("qid"), F.col("code").alias("qcode")).distinct(), "queries")
    n = book.count()
    count = max(2, round(BITS / max(1.0, log2(max(2, n)))))
    width = [BITS // count + (i < BITS % count) for i in range(count)]
    segs = _segments(F.col("code"), count, width)
    index = book.select("code", F.size("ids").alias("c"), F.explode(F.array(*[F.struct(F.lit(i).alias("s"), x.alias("v")) for i, x in enumerate(segs)])).alias("x"))
    index = stage(index.select("code", "c", F.col("x.s").alias("s"), F.col("x.v").alias("v")), "segments")

    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("qcode")))
    diffs = _segments(F.col("code").bitwiseXOR(F.col("qcode")), count, width)
    pairs, open_queries, covered = None, asked, -1
    left = asked.count()
    for t in range(max(width) + 1):
        looked_up = sum(comb(w, r) for w in width for r in range(t + 1))
        if not left or looked_up * LOOKUP_COST * left > n * count:
            break
        masks = [(i, m) for i, w in enumerate(width) for m in _masks(w, t)]
        radius = count * (t + 1) - 1
        own = _segments(F.col("qcode"), count, width)
        tries = F.array(*[_tries(s, own[s], [m for i, m in masks if i == s]) for s in range(count)])
        probes = open_queries.select("qid", "qcode", F.explode(F.flatten(tries)).alias("p")).select("qid", "qcode", "p.ps", "p.pv")
        first = F.lit(True)
        for i, d in enumerate(diffs):
            first = first & ((F.col("s") <= i) | (F.bit_count(d) > t))
        # by shuffle: the planner takes the lookups for as few as the queries they are made of
        near = probes.hint("merge").join(index, (F.col("ps") == F.col("s")) & (F.col("pv") == F.col("v")) & first & apart.between(covered + 1, radius))
        found = stage(near.select("qid", "code", apart.cast("int").alias("distance"), "c"), "verified")
        pairs = found if pairs is None else pairs.unionByName(found)
        held = pairs.groupBy("qid").agg(F.sum("c").alias("held"))
        covered = radius
        open_queries = stage(asked.join(held.where(F.col("held") > k).select(F.col("qid").alias("done")), F.col("qid") == F.col("done"), "left_anti"), "open_queries")
        left = open_queries.count()
    if left:
        pairs = _in_blocks(open_queries, left, book, n, covered, k, pairs)
    if pairs is None:
        pairs = asked.select("qid", F.lit(0).cast("bigint").alias("code"), F.lit(0).alias("distance"), F.lit(0).alias("c")).where(F.lit(False))
    named = pairs.join(book.withColumnRenamed("code", "bcode"), F.col("code") == F.col("bcode")).select("qid", "distance", F.explode("ids").alias("nid")).where("qid != nid")
    best = Window.partitionBy("qid").orderBy("distance", "nid")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("nid").alias("neighbour_id"), "distance", "rank")


class BlockIndex:
    """The codes of one block in the order of every segment's values, held in a task.

    Segments are narrow enough that a value has some dozens of codes: those lie side by side, while every lookup is a jump.
    """

    def __init__(self, codes):
        import numpy as np

        self.codes = np.ascontiguousarray(codes).view(np.uint64)
        count = max(4, round(BITS / max(2.0, log2(max(2, len(self.codes))) - 5.5)))
        self.widths = [BITS // count + (i < BITS % count) for i in range(count)]
        self.shifts = [sum(self.widths[:i]) for i in range(count)]
        self.order, self.starts, self.sorted = [], [], []
        for i, w in enumerate(self.widths):
            values = self.values(self.codes, i)
            order = np.argsort(values, kind="stable").astype(np.int32)
            self.order.append(order)
            self.sorted.append(self.codes[order])
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << w))]))

    def values(self, codes, segment: int):
        import numpy as np

        return ((codes >> np.uint64(self.shifts[segment])) & np.uint64((1 << self.widths[segment]) - 1)).astype(np.int64)

    def nearest(self, queries, k: int, covered: int = -1, most=None):
        """(position of the query, position of the code, distance) of the ``k`` nearest codes more than ``covered`` bits away, ties by position.

        ``most`` has a distance for each query beyond which its codes are not wanted.

        The radii of the segments grow by one bit in turn. Codes fewer bits apart than the sum of all (radius + 1) have a segment
        within its radius, so a query is done as soon as that sum exceeds the distance of its kth verified code (or ``most``), or
        when it has met every code, as it has once a radius is a segment's whole width. Codes farther away than the kth verified
        one are dropped where they are met.
        """
        import numpy as np

        queries = np.ascontiguousarray(queries).view(np.uint64)
        most = np.full(len(queries), BITS, np.uint8) if most is None else np.array(most, np.uint8)
        radii = [-1] * len(self.widths)
        inside = [np.uint64(((1 << w) - 1) << s) for w, s in zip(self.widths, self.shifts, strict=True)]
        met = np.zeros((len(queries), BITS + 1), np.int64)
        kept, size, still = [], 0, np.arange(len(queries))
        steps = ((r, i) for r in range(max(self.widths) + 1) for i, w in enumerate(self.widths) if r <= w)
        for r, i in steps:
            still = still[(most[still] >= sum(radii) + len(radii)) & (met[still].sum(axis=1) < len(self.codes))]
            if not len(still):
                break
            masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(self.widths[i]), r)], np.int64)
            several = max(1, LOOKUPS // len(masks))
            for at in range(0, len(still), several):
                some = still[at:at + several]
                values = (self.values(queries[some], i)[:, None] ^ masks).ravel()
                low = self.starts[i][values]
                sizes = self.starts[i][values + 1] - low
                full = np.flatnonzero(sizes)
                low, sizes, asked = low[full], sizes[full], some[full // len(masks)]
                ends = np.cumsum(sizes)
                a = 0
                while a < len(sizes):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                    each, own = sizes[a:b], asked[a:b]
                    until = np.cumsum(each)
                    place = np.repeat(low[a:b] - until + each, each)
                    place += np.arange(len(place))
                    apart = self.sorted[i][place]
                    apart ^= np.repeat(queries[own], each)
                    distance = np.bitwise_count(apart)
                    near = np.flatnonzero(distance <= np.repeat(most[own], each))
                    apart, distance, place = apart[near], distance[near].astype(np.int64), place[near]
                    new = np.ones(len(near), bool)
                    for j, radius in enumerate(radii):
                        if j != i and radius >= 0:
                            new &= np.bitwise_count(apart & inside[j]) > radius
                    query = own[np.searchsorted(until, near[new], side="right")]
                    distance, place = distance[new], place[new]
                    low_q, high_q = int(own[0]), int(own[-1]) + 1
                    rows = met[low_q:high_q]
                    rows += np.bincount((query - low_q) * (BITS + 1) + distance, minlength=rows.size).reshape(rows.shape)
                    short = (np.cumsum(rows[:, covered + 1:], axis=1) < k).sum(axis=1) + covered + 1  # the kth distance, or over BITS
                    most[low_q:high_q] = np.minimum(most[low_q:high_q], np.minimum(short, BITS))
                    good = (distance > covered) & (distance <= most[query])
                    kept.append((query[good], distance[good], self.order[i][place[good]]))
                    size += len(kept[-1][0])
                    if size > 4 * PAIRS + 2 * k * len(queries):
                        kept = [self._best(kept, k, len(queries))]
                        size = len(kept[0][0])
                    a = b
            radii[i] = r
        query, distance, code = self._best(kept, k, len(queries))
        return query, code, distance

    @staticmethod
    def _best(kept, k: int, queries: int):
        """The ``k`` nearest of each query, by query."""
        import numpy as np

        if not kept:
            return (np.empty(0, np.int64),) * 3
        query, distance, code = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((code, distance, query))
        query, distance, code = query[order], distance[order], code[order]
        best = np.arange(len(query)) - np.searchsorted(query, np.arange(queries))[query] < k
        return query[best], distance[best], code[best]


def _in_blocks(queries: DataFrame, asked: int, book: DataFrame, n: int, covered: int, k: int, pairs: DataFrame | None) -> DataFrame:
    """``pairs`` and what blocks of codes add to them: more than ``covered`` bits away, the k + 1 nearest of a block (by distance, then least id) at most.

    A task indexes one block of codes and asks it for one block of queries. Each wave of blocks is written before the next, which
    leaves out codes farther away than the k + 1 ids that a query already has.
    """
    blocks = max(1, -(-n // CODE_BLOCK))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    codes = book.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("c"), F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("cb"))
    kind = dict(queries.dtypes)["qid"]

    def run(asked, held):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(held["least"].to_numpy(), kind="stable")
        code, copies = held["code"].to_numpy()[order], held["c"].to_numpy()[order]
        qcode, most, out = asked["qcode"].to_numpy(), asked["most"].to_numpy(), []
        index = BlockIndex(code) if len(qcode) else None
        for at in range(0, len(qcode), TOGETHER):
            query, place, distance = index.nearest(qcode[at:at + TOGETHER], k + 1, covered, most[at:at + TOGETHER])
            out.append((query + at, place, distance))
        query, place, distance = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return pa.table({"qid": asked["qid"].combine_chunks().take(pa.array(query)), "code": pa.array(code[place], pa.int64()),
                         "distance": pa.array(distance, pa.int32()), "c": pa.array(copies[place], pa.int32())})

    low, high = 0, 1
    while low < blocks:
        rounds = max(-(-asked // QUERY_BLOCK), min(-(-3 * cores // (high - low)), -(-asked // 64)))
        right = codes.where(F.col("cb").between(low, high - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        left = _bounded(queries, pairs, k).withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(rounds)).cast("int"))
        left = left.withColumn("cb", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, f"qid {kind}, code bigint, distance int, c int")
        found = stage(found, "in_blocks")
        pairs = found if pairs is None else pairs.unionByName(found)
        low, high = high, min(blocks, GROWTH * high)
    return pairs


def _bounded(queries: DataFrame, pairs: DataFrame | None, k: int) -> DataFrame:
    """``queries`` with ``most``, the distance within which a query has k + 1 ids in ``pairs``; all bits without so many."""
    if pairs is None:
        return queries.withColumn("most", F.lit(BITS))
    nearer = Window.partitionBy("qid").orderBy("distance")
    held = pairs.groupBy("qid", "distance").agg(F.sum("c").alias("c")).withColumn("held", F.sum("c").over(nearer))
    held = held.where(F.col("held") > k).groupBy(F.col("qid").alias("bid")).agg(F.min("distance").alias("least"))
    return queries.join(held, F.col("qid") == F.col("bid"), "left").select("qid", "qcode", F.coalesce("least", F.lit(BITS)).alias("most"))


def _tries(segment: int, value, masks: list[int]):
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(segment).alias("ps"), value.bitwiseXOR(m).alias("pv")))


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(flips + 1) for bits in combinations(range(width), r)]
