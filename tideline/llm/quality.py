"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import slices

#: The sample that the field is fitted on: labelled documents of each class, and most lines of each (scoring reads all lines).
SAMPLE_DOCS, SAMPLE_LINES = 2000, 2000
SCORE = "__tideline_score"
#: Texts are scored in pieces of about so many characters, which bounds a task's arrays; a longer text is one piece.
PIECE_CHARS = 1 << 20

#: Bin edges of the features of a line.
EDGES = {
    "chars": (1, 40, 120, 400, 1200),
    "words": (1, 5, 20, 80, 300),
    "word_length": (2.5, 4, 5, 6, 7.5, 9, 12),
    "upper": (0.001, 0.03, 0.08, 0.2, 0.5, 0.9),
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.2, 0.35),
    "digits": (0.001, 0.02, 0.1, 0.3),
    "bars": (0.001, 0.02, 0.06),
    "marks": (0.001, 0.02, 0.06, 0.15),
    "stops": (0.0005, 0.005, 0.01, 0.02, 0.05),
    "distinct": (0.05, 0.2, 0.4, 0.6, 0.75, 0.9, 0.99),
    "repeated": (0.001, 0.05, 0.2, 0.6),
    "copies": (2, 3, 6),
}
_BINS = [len(e) + 1 for e in EDGES.values()]
_OFFSETS = np.cumsum([0, *_BINS[:-1]])
N_FEATURES = sum(_BINS)


def _byte_classes() -> np.ndarray:
    """0 other, 1 ASCII upper case, 2 lower case or part of a longer letter, 3 digit, 4 symbol, 5 bar, 6 exclamation mark, 7 stop."""
    table = np.zeros(256, np.uint8)
    table[ord("A"):ord("Z") + 1] = 1
    table[ord("a"):ord("z") + 1] = 2
    table[0x80:] = 2
    table[ord("0"):ord("9") + 1] = 3
    table[[ord(c) for c in "#$%&*+-/<=>@\\^_`~{}[]()\"'"]] = 4
    table[ord("|")], table[ord("!")] = 5, 6
    table[[ord(c) for c in ".,;:?"]] = 7
    return table


_CLASSES = _byte_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (lines x features) of all lines of all texts, the length of each line, and the number of lines of each text."""
    blob = "\n".join(texts).encode("utf-8", "replace")
    counts = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(blob, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    kinds = _CLASSES[data]
    narrow = np.int32 if len(data) < 1 << 31 else np.int64

    def share(*classes):
        hit = np.isin(kinds, classes) if len(classes) > 1 else kinds == classes[0]
        total = np.zeros(len(data) + 1, narrow)
        np.cumsum(hit, dtype=narrow, out=total[1:])
        return (total[ends] - total[starts]).astype(np.int64)

    upper, lower, digits, symbols, bars, marks, stops = (share(k) for k in (1, 2, 3, 4, 5, 6, 7))
    words, distinct, repeated, copies = [], [], [], []
    for text in texts:
        lines, seen = text.split("\n"), {}
        for line in lines:
            found = line.split()
            words.append(len(found))
            distinct.append(len(set(found)))
            repeated.append(sum(map(eq, found, found[1:])))
            seen[line] = seen.get(line, 0) + 1
        copies += [seen[line] if line else 1 for line in lines]
    words = np.array(words, dtype=np.float64)
    some, letters = np.maximum(length, 1), np.maximum(upper + lower, 1)
    values = {
        "chars": length, "words": words, "word_length": length / np.maximum(words, 1), "upper": upper / letters, "symbols": symbols / some,
        "digits": digits / some, "bars": bars / some, "marks": marks / some, "stops": stops / some,
        "distinct": np.array(distinct) / np.maximum(words, 1), "repeated": np.array(repeated) / np.maximum(words, 1), "copies": np.array(copies),
    }
    numbers = np.stack([np.digitize(values[k], EDGES[k]) for k in EDGES], axis=1) + _OFFSETS
    return numbers, length, counts


class Field:
    """A chain of two states (1 good, 0 bad). All texts of a batch advance together, a line at a time.

    A line's score adds weights of its own features and of those of its neighbours. As there are two states, the messages of
    the forward-backward recursion are single log-odds.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(3 * N_FEATURES + 3 + 4) if weights is None else weights
        self.fitted = weights is not None

    def parts(self, w):
        own, before, after = w[:3 * N_FEATURES].reshape(3, N_FEATURES)
        bias, first, last = w[3 * N_FEATURES:3 * N_FEATURES + 3]
        return own, before, after, bias, first, last, w[-4:].reshape(2, 2)

    def layout(self, counts):
        """Texts by falling number of lines; for step t the lines that stand there."""
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        falling = counts[order]
        alive = np.searchsorted(-falling, -np.arange(falling[0] if len(falling) else 0), side="left")
        return begin, alive

    def scores(self, numbers, counts):
        own, before, after, bias, first, last, _ = self.parts(self.weights)
        s = own[numbers].sum(axis=1) + bias
        begin = np.cumsum(counts) - counts
        is_first, is_last = np.zeros(len(s), bool), np.zeros(len(s), bool)
        is_first[begin], is_last[begin + counts - 1] = True, True
        s += np.where(is_first, first, np.roll(before[numbers].sum(axis=1), 1))
        return s + np.where(is_last, last, np.roll(after[numbers].sum(axis=1), -1)), is_first, is_last

    def messages(self, s, counts):
        """Forward log-odds (with the line's own score) and backward log-odds of each line."""
        a = self.parts(self.weights)[-1]
        forward, backward = s.copy(), np.zeros(len(s))
        begin, alive = self.layout(counts)
        for t in range(1, len(alive)):
            now = begin[:alive[t]] + t
            x = forward[now - 1]
            forward[now] += np.logaddexp(a[0, 1], a[1, 1] + x) - np.logaddexp(a[0, 0], a[1, 0] + x)
        for t in range(len(alive) - 1, 0, -1):
            now = begin[:alive[t]] + t
            x = s[now] + backward[now]
            backward[now - 1] = np.logaddexp(a[1, 0], a[1, 1] + x) - np.logaddexp(a[0, 0], a[0, 1] + x)
        return forward, backward

    def marginals(self, numbers, counts):
        s, _, _ = self.scores(numbers, counts)
        forward, backward = self.messages(s, counts)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))

    def fit(self, numbers, counts, labels, doc_weights, steps: int = 300, rate: float = 0.15, ridge: float = 2.0):
        """Maximum likelihood with a ridge penalty by full-batch Adam; every line carries its document's label."""
        y, weight = np.repeat(labels, counts).astype(float), np.repeat(doc_weights, counts)
        total = weight.sum()
        first_m, second_m = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            a = self.parts(self.weights)[-1]
            s, is_first, is_last = self.scores(numbers, counts)
            forward, backward = self.messages(s, counts)
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
            miss = (y - p) * weight
            spread = np.repeat(miss, numbers.shape[1])
            grad = np.zeros_like(self.weights)
            grad[:N_FEATURES] = np.bincount(numbers.ravel(), spread, N_FEATURES)
            inner = np.flatnonzero(~is_first)
            if len(inner):
                grad[N_FEATURES:2 * N_FEATURES] = np.bincount(numbers[inner - 1].ravel(), np.repeat(miss[inner], numbers.shape[1]), N_FEATURES)
                grad[2 * N_FEATURES:3 * N_FEATURES] = np.bincount(numbers[inner].ravel(), np.repeat(miss[inner - 1], numbers.shape[1]), N_FEATURES)
                x, z = forward[inner - 1], s[inner] + backward[inner]
                joint = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] + z, a[1, 0] + x, a[1, 1] + x + z])
                joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
                seen = np.stack([(1 - y[inner]), np.zeros(len(inner)), np.zeros(len(inner)), y[inner]])
                grad[-4:] = ((seen - joint) * weight[inner]).sum(axis=1)
            tail = 3 * N_FEATURES
            grad[tail:tail + 3] = miss.sum(), miss[is_first].sum(), miss[is_last].sum()
            grad = (grad - ridge * self.weights) / total
            first_m = 0.9 * first_m + 0.1 * grad
            second_m = 0.99 * second_m + 0.01 * grad ** 2
            self.weights = self.weights + rate * (first_m / (1 - 0.9 ** step)) / (np.sqrt(second_m / (1 - 0.99 ** step)) + 1e-8)
        self.fitted = True
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean probability of a good line; an empty line weighs 1."""
        if not texts:
            return np.zeros(0)
        numbers, length, counts = line_features(texts)
        weight = length + 1.0
        begin = np.cumsum(counts) - counts
        good = np.add.reduceat(self.marginals(numbers, counts) * weight, begin)
        return good / np.add.reduceat(weight, begin)


def remainder(id_column) -> F.Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4


def run_of_lines(text: str, most: int) -> str:
    """All lines of a text of ``most`` lines at most, else as many consecutive ones from a place that the text's hash draws."""
    lines = text.split("\n")
    if len(lines) <= most:
        return text
    start = crc32(text.encode("utf-8", "replace")) % (len(lines) - most + 1)
    return "\n".join(lines[start:start + most])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", held_out: int = 2, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit the field on a sample of labelled documents that the hold-out rule leaves for training.

    Of each class the ``sample_docs`` rows with the least hash of the id are taken, so the driver receives a bounded number of
    documents' features, whatever the table's size; classes are weighted by their true numbers. Documents count whole; of one
    with more than ``sample_lines`` lines a hashed run of so many does. Ids that are null, have no label or two different ones are
    passed over. Without usable labels of both classes the field stays at even odds and is not ``fitted``.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    usable = usable.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    usable = usable.where(remainder(F.col("id")) != held_out).join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").select("id", "label")
    usable = usable.withColumn("h", F.xxhash64("id"))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    sample = [(r["id"], k) for k in totals for r in usable.where(F.col("label") == k).orderBy("h", "id").limit(sample_docs).collect()]
    if len(totals) < 2:
        return Field()
    chosen = spark.createDataFrame(sample, f"_id {dict(docs.dtypes)[id_col]}, _label int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("_label", "text")

    def features(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1):
                labels_, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                if not texts:
                    continue
                texts = [run_of_lines(t, sample_lines) for t in texts]
                numbers, _, counts = line_features(texts)
                parts = np.split(numbers.astype(np.int16), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_pydict({"label": labels_, "lines": pa.array([p.tobytes() for p in parts], pa.binary())})

    got = rows.mapInArrow(features, "label int, lines binary").collect()
    got = sorted(((r["label"], bytes(r["lines"])) for r in got))
    numbers = [np.frombuffer(b, np.int16).reshape(-1, len(EDGES)) for _, b in got]
    y = np.array([k for k, _ in got])
    weights = np.array([totals[k] / max(1, (y == k).sum()) for k in y])
    counts = np.array([len(x) for x in numbers])
    return Field().fit(np.concatenate(numbers).astype(np.int64), counts, y, weights * len(y) / weights.sum())


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id, score`` of every whole text, from its text alone; with ``keep`` all columns of ``docs`` and the score under a name of its own.

    The score is between 0 and 1 and higher for label 1. A null text counts as an empty one, which is one empty line. Repeated
    rows and ties get equal scores; an empty table gives no rows; a text of any length is read whole.
    """
    weights = field.weights

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        model, out, piece, held = Field(weights), [], [], 0
        for t in texts:
            t = t or ""
            if piece and held + len(t) > PIECE_CHARS:
                out.append(model.score(piece))
                piece, held = [], 0
            piece.append(t)
            held += len(t)
        out.append(model.score(piece))
        return pd.Series(np.concatenate(out))

    text = F.col(text_col).cast("string")
    if keep:
        return docs.withColumn(SCORE, scored(text))
    return docs.select(F.col(id_col), scored(text).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``labels`` and score all ``docs``: id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(id_col, (remainder(F.col(id_col)) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; all rows if the labels allow no field."""
    field = train(docs, labels, id_col=id_col, text_col=text_col)
    if not field.fitted:
        return docs
    return score(docs, field, id_col, text_col, keep=True).where(F.col(SCORE) >= threshold).drop(SCORE)
