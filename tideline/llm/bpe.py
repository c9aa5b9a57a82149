"""Byte-level BPE by a pair occurrence index over the distinct words of a batch."""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a task remembers; beyond that it starts afresh, which changes speed only.
REMEMBERED_WORDS = 1_000_000

# The pre-tokenizer pattern and the byte letters of the public byte-level vocabularies.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """What the tasks need of a ``tokenizers`` file: token bytes by id, merges in rank order as ids, added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without normalizer is supported")
    ids = model["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for text, i in ids.items():
        tokens[i] = text.encode() if text in added else bytes(letters[c] for c in text)
    for text, i in added.items():
        tokens[i] = text.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
    rank_of = {made: r for r, (_, _, made) in enumerate(merges)}
    if any(rank_of.get(x, -1) >= r for r, (a, b, _) in enumerate(merges) for x in (a, b)):
        raise ValueError("a merge uses a token that a later merge makes")
    return {"tokens": tokens, "merges": merges, "added": added, "bytes": [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]}


class PairIndex:
    """Encodes many words together.

    The index maps the rank of each mergeable pair to all positions at which the pair stands. Ranks are applied in ascending
    order (a heap holds the active ones), each to all of its positions at once; the merges add the positions of the pairs they
    make, and positions of pairs that they break are sorted out when their rank's turn comes. A token's own pairs rank after
    the merge that makes it (checked when the vocabulary is loaded), so no rank comes up twice for one position.
    """

    def __init__(self, vocabulary: dict):
        self.first = np.array(vocabulary["bytes"], dtype=np.int64)
        self.merges = vocabulary["merges"]
        keys = np.array([(a << 20) | b for a, b, _ in self.merges], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """-1 where no merge exists."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), lengths
        at = self.first[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)[lengths > 0]
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            ranks = self.ranks((at[positions] << 20) | at[after[positions]])
            mergeable = ranks >= 0
            ranks, positions = ranks[mergeable], positions[mergeable]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank in index:
                    index[rank].append(positions[i:j])
                else:
                    index[rank] = [positions[i:j]]
                    heapq.heappush(heap, rank)

        add(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self.merges[rank]
            p = np.unique(np.concatenate(index.pop(rank)))
            q = after[p]
            stands = (at[p] == left) & (q >= 0) & (at[q] == right)
            p, q = p[stands], q[stands]
            if left == right and len(p) > 1:  # of overlapping pairs every second one, from the left
                starts = np.concatenate([[True], q[:-1] != p[1:]])
                run = np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
                keep = (np.arange(len(p)) - run) % 2 == 0
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            at[p], at[q] = made, -1
            after[p] = after[q]
            follows = p[after[p] >= 0]
            before[after[follows]] = follows
            leads = before[p]
            add(np.concatenate([leads[leads >= 0], follows]))
        alive = at >= 0
        owner = np.repeat(np.arange(len(words)), lengths)
        return at[alive].astype(np.uint32), np.bincount(owner[alive], minlength=len(words))


class Codec:
    """Encodes and decodes texts; remembers the ids of words it has met."""

    def __init__(self, vocabulary: dict):
        import regex

        self.index = PairIndex(vocabulary)
        self.added = vocabulary["added"]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.find = regex.compile(WORD_PATTERN).findall
        self.token_length = np.fromiter(map(len, vocabulary["tokens"]), dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(vocabulary["tokens"]), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        """Added tokens are words of their own, with their one id."""
        self.known = {("", t): i for i, t in enumerate(self.added)}
        self.starts = np.arange(len(self.added), dtype=np.int64)
        self.lengths = np.ones(len(self.added), dtype=np.int64)
        self.ids = np.array(list(self.added.values()), dtype=np.uint32)

    def words(self, text: str) -> list:
        if self.split is None or not any(t in text for t in self.added):
            return self.find(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.find(text[at:m.start()])
            out.append(("", m[0]))
            at = m.end()
        return out + self.find(text[at:])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        split = [self.words(t) for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        if new:
            ids, lengths = self.index.encode([w.encode() for w in new])
            self.known.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        for words in split:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            yield gather(self.ids, self.starts[at], self.lengths[at])

    def decode(self, ids: np.ndarray) -> str:
        at = ids.astype(np.int64)
        return gather(self.token_bytes, self.token_start[at], self.token_length[at]).tobytes().decode("utf-8", "replace")


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """One codec for each call of encode(), kept by the worker from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def slices(batch, column: int, limit: int = 1 << 23) -> Iterator:
    """Cut an Arrow batch so that the texts of a piece have about ``limit`` bytes; a single longer text stays whole."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text with a byte-level BPE file of the ``tokenizers`` library and decode the ids again.

    The driver reads the file (its size is fixed by the vocabulary) and broadcasts it. Each task splits its texts into words,
    encodes the words it has not met by the pair occurrence index, and looks up the rest. Strings of added tokens in a text
    become their ids, as the library does by default.

    Returns id, n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256 and, if asked for, ids. A null text is
    encoded like an empty one: no ids. Rows are independent, so repeated rows, ties and null ids need no rule; an empty table
    gives no rows; other columns are ignored. A text of any length is encoded whole, in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    kind, key = dict(docs.dtypes)[id_col], uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        codec = _codec(key, shared)
        for whole in batches:
            for batch in slices(whole, 1):
                counts, id_hashes, text_hashes, lists = [], [], [], []
                for ids in codec.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hashes.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                columns = {"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hashes, pa.string()),
                           "decoded_sha256": pa.array(text_hashes, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema) \
        .withColumnRenamed("id", id_col)
