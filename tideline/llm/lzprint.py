"""Document fingerprints from Lempel-Ziv phrases: the least hashes of the phrases that a parse of the text makes."""

from __future__ import annotations

import hashlib
from math import ceil, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least hashes that a fingerprint keeps, and the most range partitions that documents are ordered in.
SIGNATURE, MOST_RANGES = 128, 16384

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def parse(text: str, known: set[str] | None = None, ends: list[int] | None = None) -> tuple[set[str], list[int]]:
    """Cut ``text`` into dictionary phrases: each is the shortest string from where it starts that is no phrase yet.

    Returns the phrases and their ends. A parse can go on from the phrases and ends of one that began alike. The dictionary
    holds every beginning of its phrases, so the search may start at a guessed length and move either way. What is left at the
    end and is a phrase already adds none.
    """
    known, ends = set() if known is None else known, [] if ends is None else ends
    at, n, guess = ends[-1] if ends else 0, len(text), 1
    add, note = known.add, ends.append
    while at < n:
        end = at + guess
        phrase = text[at:end]
        if phrase in known:
            while phrase in known:
                if end >= n:
                    return known, ends
                end += 1
                phrase = text[at:end]
        else:
            if end > n:
                end = n
            while end - at > 1:
                shorter = text[at:end - 1]
                if shorter in known:
                    break
                phrase = shorter
                end -= 1
        add(phrase)
        note(end)
        guess = end - at
        at = end
    return known, ends


def signature(text: str, ends: list[int], size: int = SIGNATURE) -> np.ndarray:
    """The ``size`` least 32-bit hashes of the phrases with these ends."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    powers, inverse = _power(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[:len(points)], dtype=np.uint64)])
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    h = (sums[stop] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * size:
        h = np.partition(h, 2 * size)[:2 * size]  # phrases are distinct, so this leaves enough
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Share of common phrases, estimated on the least hashes of both; exact below ``size`` phrases. Two empty texts are alike."""
    union = np.union1d(a, b)
    if len(a) >= size or len(b) >= size:
        union = union[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def shown(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


class _Parsed:
    def __init__(self, id_, text):
        self.id, self.text = id_, text
        self.known, self.ends = parse(text)
        self.print = signature(text, self.ends)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The last half replaced by the beginning of ``other``; the parse goes on where the common beginning ends."""
        gone = len(self.text) // 2
        kept = len(self.text) - gone
        text = self.text[:kept] + other[:gone]
        same = int(np.searchsorted(self.ends, kept, side="right"))
        ends = self.ends[:same]
        known = {text[i:j] for i, j in zip([0, *ends], ends, strict=False)}
        _, ends = parse(text, known, ends)
        return text, signature(text, ends)


def _ranges(docs: DataFrame, id_col: str):
    """(expression of a row's range, expression of the range that also needs the row as its last neighbour, number of ranges)."""
    ids = docs.select(F.col(id_col).alias("id"))
    wanted = min(MOST_RANGES, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = []
    if wanted > 1:
        cuts = [i / wanted for i in range(1, wanted)]
        found = ids.agg(F.percentile_approx("id", F.array(*[F.lit(c) for c in cuts]), F.lit(max(10_000, 20 * wanted)))).first()[0] or []
        bounds = sorted(set(found))

    def place(c):
        """1 + the number of bounds at or below the id, by two short searches; 0 for a null id."""
        if not bounds:
            return F.when(c.isNull(), 0).otherwise(1)
        step = ceil(sqrt(len(bounds)))
        rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
        coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= c))
        fine = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
        inside = F.size(F.filter(F.get(fine, coarse - 1), lambda b: b <= c))
        return F.when(c.isNull(), 0).when(coarse == 0, 1).otherwise(1 + (coarse - 1) * step + inside)

    firsts = ids.select("id", place(F.col("id")).alias("p")).groupBy("p").agg(F.min("id").alias("first")).orderBy("p").collect()
    filled = [r["p"] for r in firsts]
    first, before = [None] * (len(bounds) + 2), [-1] * (len(bounds) + 2)
    for i, r in enumerate(firsts):
        first[r["p"]], before[r["p"]] = r["first"], filled[i - 1]
    return place, first, before, max(1, len(filled))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare it with that and with the next document.

    The next document is the next in ascending id (null ids first, ties by text; after the last comes the first). Texts move
    once: rows are dealt by ranges of the id, and the first row of a range goes to the range before it as well. Each task reads
    its rows in order and holds two documents at a time. The driver receives one id for each range.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty; an
    empty text is all like its edited text and has an empty fingerprint. Repeated rows are neighbours of each other. A single
    row is its own next; an empty table gives no rows. Other columns are ignored; ids must be numbers.
    """
    kind = dict(docs.dtypes)[id_col]
    place, first, before, filled = _ranges(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("p", place(F.col("id")))
    first_of = F.get(F.array(*[F.lit(f).cast(kind) for f in first]), F.col("p"))
    before_of = F.get(F.array(*[F.lit(b) for b in before]), F.col("p"))
    here = F.struct(F.col("p").alias("p"), F.lit(False).alias("guest"))
    targets = F.when(F.col("id").eqNullSafe(first_of), F.array(here, F.struct(before_of.alias("p"), F.lit(True).alias("guest")))).otherwise(F.array(here))
    rows = rows.select("id", "text", F.explode(targets).alias("t")).select("t.p", "t.guest", "id", "text")
    rows = rows.repartition(filled, "p").sortWithinPartitions("p", "guest", F.col("id").asc_nulls_first(), "text")

    def run(batches):
        import pyarrow as pa

        columns = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        last, place_of_last, out = None, None, []
        done = False  # the range in hand has met its guest

        def finish(doc, other):
            text, changed = doc.edited(other.text)
            return (doc.id, len(doc.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), shown(doc.print), shown(changed),
                    likeness(doc.print, changed), likeness(doc.print, other.print))

        for batch in batches:
            ps, guests, ids, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                p, guest = ps[i].as_py(), guests[i].as_py()
                if p != place_of_last:
                    last, place_of_last, done = None, p, False
                if done:
                    continue
                doc = _Parsed(ids[i].as_py(), texts[i].as_py())
                if last is not None:
                    out.append(finish(last, doc))
                last, done = doc, guest
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
