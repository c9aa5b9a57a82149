"""SimHash near-duplicates: fingerprints of word shingles, linked through a pigeonring filter."""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import slices
from tideline.llm.common import stage
from tideline.llm.components import connected_components

#: Masks that a probe may try at one start of the ring; more would be a sign of too wide a distance for this index.
MOST_MASKS = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, repeats included; A-Z are lower-cased, words end at ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[min(words, len(found)) - 1:].tolist()
    return np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit number: a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (bigint) for every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                fps = [simhash(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(fps, pa.int64())})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


class Ring:
    """The pigeonring of 64-bit fingerprints: ``segments`` equal segments, of which two neighbours form an index key.

    If two fingerprints differ in ``distance`` bits at most, some start on the ring has, for every l, at most
    l * distance / segments differing bits in the l segments from there on.
    """

    def __init__(self, distance: int, segments: int):
        if 64 % segments or segments < 2:
            raise ValueError("segments must divide 64")
        self.distance, self.segments, self.width = distance, segments, 64 // segments
        self.budgets = [length * distance // segments for length in range(1, segments + 1)]

    def turned(self, x: Column, start: int) -> Column:
        by = start * self.width
        return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))

    def chain(self, diff: Column, start: int) -> Column:
        """True if every chain of segments from ``start`` keeps its budget; ``diff`` is the exclusive or of two fingerprints."""
        turned = self.turned(diff, start)
        ok = F.lit(True)
        for length, budget in enumerate(self.budgets, 1):
            part = turned if length == self.segments else F.shiftrightunsigned(turned, 64 - length * self.width)
            ok = ok & (F.bit_count(part) <= budget)
        return ok

    def masks(self) -> list[int]:
        """Differences of a key that the first two budgets allow."""
        w, out = self.width, []
        for flips in range(self.budgets[1] + 1):
            for bits in combinations(range(2 * w), flips):
                if sum(b >= w for b in bits) <= self.budgets[0]:
                    out.append(sum(1 << b for b in bits))
        if len(out) > MOST_MASKS:
            raise ValueError("the distance is too wide for an index on two segments")
        return out

    def links(self, fps: DataFrame) -> DataFrame:
        """``a, b``: each pair of distinct fingerprints (column fp) at most ``distance`` bits apart, once.

        A fingerprint is filed under its key at every start, and looks up its keys with every allowed difference; of two
        fingerprints whose keys differ only the one looks up whose lowest differing bit is 0. Of several viable starts the
        first counts. The number of neighbours of a fingerprint is bounded by the distance, however many texts share it.
        """
        w, masks = self.width, self.masks()
        keys = [F.shiftrightunsigned(self.turned(F.col("fp"), s), 64 - 2 * w) for s in range(self.segments)]
        starts = F.array(*[F.struct(F.lit(s).alias("s"), k.alias("k")) for s, k in enumerate(keys)])
        filed = fps.select("fp", F.explode(starts).alias("x")).select(F.col("fp").alias("b"), "x.s", "x.k")
        tries = F.filter(F.array(*[F.lit(m).cast("bigint") for m in masks]),
                         lambda m: (m == 0) | (F.col("x.k").bitwiseAND(m.bitwiseAND(-m)) == 0))
        probes = fps.select("fp", F.explode(starts).alias("x")).select(F.col("fp").alias("a"), F.col("x.s").alias("ps"), "x.k", F.explode(tries).alias("mask"))
        probes = probes.select("a", "ps", "mask", F.col("k").bitwiseXOR(F.col("mask")).alias("pk"))
        diff = F.col("a").bitwiseXOR(F.col("b"))
        first, earlier = F.lit(False), F.lit(False)
        for start in range(self.segments):
            viable = self.chain(diff, start)
            first = first | ((F.col("s") == start) & viable & ~earlier)
            earlier = earlier | viable
        on = (F.col("k") == F.col("pk")) & (F.col("s") == F.col("ps")) & ((F.col("mask") != 0) | (F.col("a") < F.col("b"))) & first
        return probes.join(filed, on).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 3, segments: int = 4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every row's fingerprint and the group of near-duplicates that it belongs to.

    Fingerprints link if they differ in ``distance`` bits at most; groups are the connected components. Equal fingerprints are
    one node, so copies are never paired; links come from the ring index, and each is checked in full.

    Returns id, fingerprint (16 hex digits) and component_id, the least id of the group. Null and empty texts have fingerprint
    zero and link like any other. Null ids are never a component_id unless the group has no other; repeated rows and ids keep
    all their rows. An empty table gives no rows; other columns are ignored.
    """
    prints = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    groups = connected_components(Ring(distance, segments).links(nodes.select("fp")))
    groups = stage(groups.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "first"), "groups")
    least = stage(groups.groupBy("root").agg(F.min("first").alias("component")).withColumnRenamed("root", "_root"), "group_ids")
    named = groups.join(least, F.col("root") == F.col("_root")).select("node", "component")
    nodes = stage(nodes.join(named, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component_id")), "named_nodes")
    return prints.join(nodes, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates by the similarity of their shingle sets -----------------------------------------------------------

def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))


def _profile(text, words, bands, rows, multipliers):
    hashes = shingle_hashes(text, words)
    whole, fp = np.unique(hashes), simhash(hashes)
    same = md5(whole.tobytes()).digest()
    kinds = np.unique(whole >> np.uint64(32))
    if not len(kinds):
        return same, [], 0, fp
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(kinds), 4096):
        part = kinds[at:at + 4096][:, None] * multipliers[None, :]
        least = np.minimum(least, part.min(axis=0))
    mixed = (least.reshape(bands, rows) >> np.uint64(8)) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                                      0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63][:rows], np.uint64)
    keys = (mixed.sum(axis=1, dtype=np.uint64) ^ (np.arange(bands, dtype=np.uint64) << np.uint64(57))).view(np.int64)
    return same, keys.tolist(), len(whole), fp


#: Rows, and shingles of all of them, outside and inside a bucket's largest component that one cell compares.
CELL_ROWS, CELL_SHINGLES = (1024, 4096), (1 << 18, 1 << 20)


def _links_between_parts(rows: DataFrame, kind: str, least: float) -> DataFrame:
    """``a, b``: links of ``least`` or more between different components that share a bucket.

    ``rows`` has key, id, part and whole (its set), and of the bucket main (its largest component), n and apart (rows in all and
    outside of main), shingles and apart_shingles (those of these rows). The rows outside are compared with all, in cells of
    bounded size; large buckets are split into several. A task reads its cells one after another and gives no more links than it
    takes to join what a cell joins, so pairs are never rows.
    """
    blocks = [F.ceil(F.greatest(F.col(c) / size, F.col(w) / most)).cast("int")
              for c, size, w, most in zip(("apart", "n"), CELL_ROWS, ("apart_shingles", "shingles"), CELL_SHINGLES, strict=True)]
    own = [F.pmod(F.xxhash64("id"), blocks[0]).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), blocks[1]).cast("int")]
    cell = lambda i, j, outside: F.struct(i.alias("i"), j.alias("j"), F.lit(outside).alias("outside"))
    every = F.transform(F.sequence(F.lit(0), blocks[0] - 1), lambda i: cell(i, own[1], False))
    outside = F.when(F.col("part") != F.col("main"), F.transform(F.sequence(F.lit(0), blocks[1] - 1), lambda j: cell(own[0], j, True)))
    cells = rows.select("key", "id", "part", "whole", F.explode(F.concat(every, F.coalesce(outside, F.slice(every, 1, 0)))).alias("c"))
    cells = cells.select("key", "c.i", "c.j", "c.outside", "id", "part", "whole").repartition("key", "i", "j")
    cells = cells.sortWithinPartitions("key", "i", "j")

    def compare(found: list[tuple]) -> list[tuple]:
        here, there = [r for r in found if r[0]], [r for r in found if not r[0]]
        if not here:
            return []
        joined: dict = {}

        def root(part):
            while joined.get(part, part) != part:
                part = joined[part]
            return part

        sizes = np.array([len(r[3]) for r in here])
        values = np.concatenate([r[3] for r in here])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], np.repeat(np.arange(len(here)), sizes)[order]
        out = []
        for _, id_, part, mine in there:
            start, stop = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
            lengths = stop - start
            at = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            common = np.bincount(owners[at], minlength=len(here))
            for k in np.flatnonzero(common / (sizes + len(mine) - common) >= least).tolist():
                x, y = root(part), root(here[k][2])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((id_, here[k][1]))
        return out

    def run(batches):
        import pyarrow as pa

        last, held, out = None, [], []
        for batch in batches:
            key, i, j, outside, id_, part = (batch.column(c).to_pylist() for c in range(6))
            ends, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            whole = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            for now, row in zip(zip(key, i, j, strict=True), zip(outside, id_, part, whole, strict=True), strict=True):
                if now != last:
                    out += compare(held)
                    last, held = now, []
                held.append(row)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], batch.schema.field(4).type), "b": pa.array([y for _, y in out], batch.schema.field(4).type)})
            out = []
            kept = batch.schema.field(4).type
        if held:
            out = compare(held)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], kept), "b": pa.array([y for _, y in out], kept)})

    return cells.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _ring_buckets(heads: DataFrame, distance: int, segments: int) -> DataFrame:
    """``id, size, key``: heads whose fingerprints are in one component of the ring's links have one key."""
    prints = heads.where("size > 0").select("id", "size", "fp")
    groups = stage(connected_components(Ring(distance, segments).links(stage(prints.select("fp").distinct(), "ring_prints"))), "ring_groups")
    # always by shuffle: fingerprints with neighbours grow with the corpus
    named = prints.join(groups.hint("merge"), F.col("fp") == F.col("node"), "left")
    return named.select("id", "size", F.xxhash64(F.lit("ring"), F.coalesce("root", "fp")).alias("key"))


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, id_col: str = "doc_id",
                    text_col: str = "text", distance: int = 3, segments: int = 4) -> DataFrame:
    """``id, group`` for every id: texts whose sets of shingles are ``least`` similar or more are linked, groups are components.

    Candidates are the groups of SimHash fingerprints of the shingles, linked at ``distance`` bits or fewer by the ring, as in
    :func:`simhash_groups`. At 0.8 fingerprints differ in about ten of 64 bits, which no index over segments reaches, so texts
    that share one of ``bands`` keys of ``rows`` minimum hashes of the same shingles are candidates too (a pair at 0.8 is missed
    once in 2,500). No fingerprint prunes these: it counts repeats, which the sets do not. The whole sets decide, as 64-bit
    hashes; a pair goes undecided only where the sizes of its sets forbid ``least``. Sets are made again from the texts that
    share a key with others.

    Equal shingle sets are one node. In a bucket every node is first compared with one pivot; afterwards only nodes of different
    components are compared, those outside the bucket's largest one with the others, inside tasks that give the links alone.

    Null and empty texts equal each other. Rows that share an id count as one document; rows without id are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    multipliers = np.random.default_rng(7).integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                found = [_profile(t, words, bands, rows, multipliers) for t in batch.column(1).to_pylist()]
                same, keys, size, fp = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0), "same": pa.array(same, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())),
                    "size": pa.array(size, pa.int64()), "fp": pa.array(fp, pa.int64())})

    def hashed(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                found = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"sid": batch.column(0), "whole": pa.array(found, pa.list_(pa.int64()))})

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = stage(texts.mapInArrow(run, f"id {kind}, same binary, keys array<bigint>, size bigint, fp bigint"), "profiles")
    nodes = profiles.groupBy("same").agg(F.min("id").alias("node"))
    copies = stage(profiles.select("id", "same").join(stage(nodes, "set_nodes"), "same").select("id", "node"), "copies")
    heads = profiles.join(copies.where("id = node").select(F.col("node")).distinct(), F.col("id") == F.col("node"), "left_semi")
    filed = heads.select("id", "size", F.explode("keys").alias("key")).unionByName(_ring_buckets(heads, distance, segments))
    filed = stage(filed, "buckets")

    pivots = filed.groupBy("key").agg(F.min(F.struct("id", "size")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pivots = stage(pivots.select(F.col("key").alias("pkey"), F.col("p.id").alias("pid"), F.col("p.size").alias("psize")), "pivots")
    tied = stage(filed.join(pivots, F.col("key") == F.col("pkey")).drop("pkey"), "tied")
    needed = stage(tied.select(F.col("id").alias("nid")).distinct(), "needed")
    # always by shuffle: the texts that meet others grow with the corpus
    sets = texts.join(needed.hint("merge"), F.col("id") == F.col("nid"), "left_semi")
    sets = stage(sets.mapInArrow(hashed, f"sid {kind}, whole array<bigint>"), "sets")

    fits = F.least("size", "psize") / F.greatest("size", "psize") >= least
    pairs = stage(tied.where(F.col("id") != F.col("pid")).where(fits).select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct(), "candidates")
    left = sets.join(pairs, F.col("sid") == F.col("a")).select("a", "b", F.col("whole").alias("other"))
    alike = F.transform(F.array(F.size(F.array_intersect("other", "whole"))), lambda n: n / (F.size("other") + F.size("whole") - n))[0]
    both = left.join(sets, F.col("sid") == F.col("b")).select("a", "b", alike.alias("s"))
    links = stage(both.where(F.col("s") >= least).select("a", "b"), "alike")
    parts = stage(connected_components(links).withColumnRenamed("node", "member"), "parts")

    placed = stage(tied.join(parts, F.col("id") == F.col("member"), "left").select("key", "id", "size", F.coalesce("root", "id").alias("part")), "placed")
    mixed = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).groupBy("key").agg(
        F.max_by(F.struct("part", "n", "shingles"), F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"),
        F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = stage(mixed.select(F.col("key").alias("mkey"), F.col("main.part").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("apart"), "shingles",
                               (F.col("shingles") - F.col("main.shingles")).alias("apart_shingles")), "mixed")
    open_rows = placed.join(mixed, F.col("key") == F.col("mkey")).join(sets, F.col("id") == F.col("sid"))
    more = stage(_links_between_parts(open_rows, kind, least), "more_links")
    groups = stage(connected_components(links.unionByName(more)).withColumnRenamed("node", "member"), "near_groups")
    named = copies.join(groups, F.col("node") == F.col("member"), "left").select("id", F.coalesce("root", "node").alias("group"))
    return stage(named.groupBy("id").agg(F.min("group").alias("group")), "groups").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows of all but the least id of each group of near-duplicates; rows without id stay."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = groups.where(F.col(id_col) != F.col("group")).select(F.col(id_col).alias("__tideline_gone"))
    # always by shuffle: copies grow with the corpus
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col("__tideline_gone"), "left_anti")
