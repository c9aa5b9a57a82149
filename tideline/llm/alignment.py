"""Alignment of two tokenizers over the same bytes: common ends, groups of tokens, and links between overlapping tokens."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import Codec, load_vocabulary
from tideline.llm.common import stage

#: Documents of about so many bytes of text are aligned, and later counted, together; a longer one is a block of its own.
BLOCK_BYTES = 1 << 20

ROWS = ("block string, place int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<bigint>, counts array<bigint>")


def load_files(byte_bpe_path: str, piece_path: str) -> tuple[dict, bytes]:
    with open(piece_path, "rb") as f:
        return {**load_vocabulary(byte_bpe_path), "added": {}}, f.read()  # without added tokens their strings are plain text


class Pair:
    """Both tokenizers, and Arrow tables of what their ids stand for."""

    def __init__(self, files: tuple[dict, bytes]):
        import pyarrow as pa
        import sentencepiece

        vocabulary, model = files
        self.a, self.b = Codec(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = pa.array(vocabulary["tokens"], pa.binary())
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.b_bytes = pa.array(pieces, pa.binary())
        self.names = pa.array([str(i) for i in range(max(len(self.a_bytes), len(pieces)))], pa.string())

    def tokens(self, texts: list[str]):
        """List arrays of the ids of both, empty where the text is or where either doesn't give its bytes back."""
        import pyarrow as pa

        a = [ids.astype(np.int32) for ids in self.a.encode_batch([" " + t for t in texts])]
        b = [np.array(ids, dtype=np.int32) for ids in self.b.encode(texts, num_threads=1)]
        kept = []
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            flat = table.take(pa.array(np.concatenate(ids)))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32)[:len(flat) + 1][ends]
            data = memoryview(flat.buffers()[2]) if flat.buffers()[2] is not None else b""
            kept.append([bytes(data[offsets[i]:offsets[i + 1]]) for i in range(len(texts))])
        whole = [bool(t) and x == y == (" " + t).encode() for t, x, y in zip(texts, *kept, strict=True)]
        none = np.empty(0, dtype=np.int32)
        return tuple(pa.array([x if ok else none for x, ok in zip(ids, whole, strict=True)], pa.list_(pa.int32())) for ids in (a, b))


_pairs: dict[str, Pair] = {}


def _pair(key: str, shared) -> Pair:
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(shared.value)
    return _pairs[key]


def token_ends(lists, table):
    """Arrow table (key, at, id): the end of every token in bytes of its document, as document << 40 | end, by segmented cumulative sums."""
    import pyarrow as pa
    import pyarrow.compute as pc

    flat, parent = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    running = pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(table), flat), pa.int64()))
    starts = pc.take(pc.cast(lists.offsets, pa.int64()), parent)  # first token of the token's document
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), running.combine_chunks() if isinstance(running, pa.ChunkedArray) else running]), starts)
    key = pc.bit_wise_or(pc.shift_left(parent, pa.scalar(40, pa.int64())), pc.subtract(running, before))
    return pa.table({"key": key, "at": pa.array(np.arange(len(flat))), "id": flat})


def align(pair: Pair, texts: list[str | None]):
    """What a block of documents gives: a table with a row for every document, and its links as (place, pair) rows.

    Token ends of both tokenizers meet in an outer join on (document, end). Between two neighbouring ends of either there is
    just one token of each, the next to end, so the sorted ends are the links, and the ends of both the groups.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pair.tokens([t or "" for t in texts])
    a, b = (token_ends(x, y) for x, y in zip(lists, (pair.a_bytes, pair.b_bytes), strict=True))
    both = a.join(b, "key", join_type="full outer", right_suffix="_b", use_threads=False).sort_by("key").combine_chunks()
    common = both.filter(pc.and_(pc.is_valid(both["at"]), pc.is_valid(both["at_b"])))
    place = pc.shift_right(both["key"], pa.scalar(40, pa.int64()))
    # every document ends with an end of both: a fill from behind never leaves it
    code = pc.bit_wise_or(pc.shift_left(pc.cast(pc.fill_null_backward(both["id"]), pa.int64()), pa.scalar(32, pa.int64())),
                          pc.cast(pc.fill_null_backward(both["id_b"]), pa.int64()))
    links = pa.table({"place": place, "pair": code})

    def per_doc(keys):
        return np.bincount(np.asarray(keys), minlength=len(texts))

    groups = per_doc(pc.shift_right(common["key"], pa.scalar(40, pa.int64())))
    words = [pc.binary_join(pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.asarray(common[at]) + 1]), pa.int32()), pc.take(pair.names, pc.list_flatten(x))), ",")
        for at, x in (("at", lists[0]), ("at_b", lists[1]))]
    cut = pa.array(np.concatenate([[0], np.cumsum(groups)]), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(cut, pc.binary_join_element_wise(*words, "|")), ";")
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text.to_pylist()]
    return pa.table({"n_a": pc.cast(pc.list_value_length(lists[0]), pa.int64()), "n_b": pc.cast(pc.list_value_length(lists[1]), pa.int64()),
                     "n_groups": pa.array(groups, pa.int64()), "n_links": pa.array(per_doc(place), pa.int64()),
                     "groups_sha256": pa.array(digests, pa.string())}), links


def _lists(keys: np.ndarray, values, count: int):
    """List array of ``values`` (sorted by ``keys``) with one list for each key below ``count``."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=count))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)


def blocks(batches, limit: int) -> Iterator:
    """Arrow batches (id, text) joined and cut into tables of about ``limit`` bytes of text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def block_links(docs: DataFrame, files: tuple[dict, bytes], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of :data:`ROWS`: for every document its numbers and its distinct pairs with their counts, and for every block a row
    (place -1) with the partial counts of all its links."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    kind, key = dict(docs.dtypes)["id"], uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        pair = _pair(key, shared)
        for table in blocks(batches, block_bytes):
            rows, links = align(pair, table.column("text").to_pylist())
            counts = links.group_by(["place", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("place")
            keys = np.asarray(counts["place"])
            n, name = rows.num_rows, uuid.uuid4().hex
            whole = counts.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
            docs_part = pa.table({
                "block": pa.array([name] * n, pa.string()), "place": pa.array(range(n), pa.int32()), "id": table.column("id"),
                **{c: rows[c] for c in rows.column_names}, "pairs": _lists(keys, counts["pair"], n), "counts": _lists(keys, counts["count_all"], n)})
            one = np.zeros(whole.num_rows, dtype=np.int64)
            block_part = pa.table({
                "block": pa.array([name], pa.string()), "place": pa.array([-1], pa.int32()), "id": pa.nulls(1, table.schema.field("id").type),
                **{c: pa.nulls(1, rows.schema.field(c).type) for c in rows.column_names},
                "pairs": _lists(one, whole["pair"], 1), "counts": _lists(one, whole["count_all_sum"], 1)})
            yield from docs_part.to_batches()
            yield from block_part.to_batches()

    return docs.mapInArrow(run, ROWS.format(kind=kind))


def pair_counts(parts: DataFrame) -> DataFrame:
    """``pair, total, best``: links of every id pair in the corpus, and whether no pair of its second id has more."""
    flat = parts.where("place < 0").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = stage(flat.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")), "pair_totals")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = totals.groupBy(second.alias("_b")).agg(F.max("total").alias("_most"))
    return totals.join(most, second == F.col("_b")).select("pair", "total", (F.col("total") == F.col("_most")).cast("int").alias("best"))


def aligned(docs: DataFrame, byte_bpe_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Align a byte-level BPE (A, on a space and the text) with a sentencepiece model (B, on the text) for every whole text.

    Returns id, n_a, n_b, n_groups (runs of tokens between byte offsets where tokens of both end), n_links (pairs of token
    occurrences whose bytes overlap), n_best (links whose id pair is as frequent in the corpus as any pair of its B id), count_sum
    (corpus counts of the pairs of all links) and groups_sha256 of the groups' ids (a1,a2|b1;a3|b2,b3).

    Tasks align blocks of documents in Arrow and write them once, with each block's partial counts. Spark sums these over the
    corpus, gives every block the totals of its own pairs, and the block's documents look theirs up by a join inside the block. A
    pair that occurs everywhere is one row a block. The vocabularies' sizes bound the broadcast of the two files.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros, and an empty
    groups_sha256. Strings of special tokens are plain text. Rows are independent: repeated rows count as often as they occur,
    ties are all best, ids may be null. A long text is one block. An empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = stage(block_links(texts, load_files(byte_bpe_path, piece_path), block_bytes), "aligned_blocks")
    mine = parts.where("place < 0").select("block", F.explode("pairs").alias("pair"))
    totals = stage(mine.join(pair_counts(parts), "pair"), "block_totals")

    def count(documents, totals):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = documents["pairs"].combine_chunks()
        flat = pa.table({"row": pc.list_parent_indices(lists), "pair": pc.list_flatten(lists), "n": pc.list_flatten(documents["counts"].combine_chunks())})
        if flat.num_rows:
            flat = flat.join(totals.select(["pair", "total", "best"]), "pair", use_threads=False)
        else:
            flat = flat.append_column("total", pa.array([], pa.int64())).append_column("best", pa.array([], pa.int32()))
        flat = pa.table({"row": flat["row"], "count_sum": pc.multiply(flat["n"], flat["total"]), "n_best": pc.multiply(flat["n"], pc.cast(flat["best"], pa.int64()))})
        sums = flat.group_by("row", use_threads=False).aggregate([("count_sum", "sum"), ("n_best", "sum")])
        out = {c: np.zeros(documents.num_rows, dtype=np.int64) for c in ("count_sum", "n_best")}
        for c, values in out.items():
            values[np.asarray(sums["row"])] = np.asarray(sums[f"{c}_sum"])
        keep = ["id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table({**{c: documents[c] for c in keep}, "n_best": out["n_best"], "count_sum": out["count_sum"], "groups_sha256": documents["groups_sha256"]})

    done = parts.where("place >= 0").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        count, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return done.withColumnRenamed("id", id_col)
