"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage

#: Permitted lengths, fixed cost of a sequence in tokens, and pieces that are packed together.
LENGTHS, OVERHEAD, GROUP = (1024, 2048, 4096, 8192), 16, 4096


def pack(lengths: list[int], permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of every piece; bins are numbered from 0.

    Pieces come by falling length. Each goes to the open bin with the least room that holds it. If none does, a bin is opened,
    of the permitted length with the least cost for each token it is going to hold: (length + overhead) over the piece plus the
    tokens still to come in pieces that fit beside it, or over the length if there are more. In the end every bin shrinks to the
    least permitted length that holds its contents.
    """
    permitted = tuple(sorted(permitted))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    rising = [-x for x in falling]
    behind = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]]) if falling else np.zeros(1)
    rooms: list[int] = []
    holders: dict[int, list[int]] = {}
    used: list[int] = []
    size: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k, i in enumerate(order):
        n = falling[k]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(at)
        else:
            b, room = len(used), 0
            cost = 0.0
            for c in permitted:
                if c >= n:
                    beside = behind[max(k + 1, bisect_left(rising, n - c))]
                    now = (c + overhead) / min(c, n + beside)
                    if not room or now < cost:
                        room, cost = c, now
            used.append(0)
            size.append(room)
        out[i] = (b, used[b])
        used[b] += n
        room -= n
        if room:
            if room not in holders:
                holders[room] = []
                insort(rooms, room)
            holders[room].append(b)
    shrunk = [permitted[bisect_left(permitted, u)] for u in used]
    return [(b, shrunk[b], offset) for b, offset in out]


def pack_documents(docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP, length=None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document; one row for each piece: id, piece, start, length, bin, capacity, offset.

    A document's length is the number of bytes of its text in UTF-8 (the tokens of a byte-level model), or the expression
    ``length``. Documents longer than the greatest permitted length are cut into pieces of that length and a rest. Pieces are
    dealt at random into groups of about ``group`` pieces, however long their table is, and each group is packed by best fit;
    a group loses a part of one bin at most, which is under a thousandth of its tokens. Only ids and lengths are moved.

    Documents of length 0, null texts among them, are one piece without bin, capacity and offset. Every row is packed, repeated
    ones too; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    most = max(permitted)
    kind = dict(docs.dtypes)[id_col]
    size = F.octet_length(F.col(text_col).cast("string")) if length is None else length
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("total"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(total - 1) div {most}")))))
    rows = rows.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"),
                       F.least(F.col("total") - F.col("piece") * most, F.lit(most)).cast("int").alias("length"))
    rows = stage(rows, "pieces")
    groups = max(1, -(-rows.where("length > 0").count() // group))
    # the number of a row in stored files is the same whenever a task is run again, so copies of a row part as well
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        placed = pack(table["length"].to_pylist(), permitted, overhead)
        base = key[0].as_py() << 24
        columns = {c: table[c] for c in ("id", "piece", "start", "length")}
        columns |= {"bin": pa.array([base + b for b, _, _ in placed], pa.int64()), "capacity": pa.array([c for _, c, _ in placed], pa.int32()),
                    "offset": pa.array([o for _, _, o in placed], pa.int32())}
        return pa.table(columns)

    schema = f"id {kind}, piece int, start bigint, length int, bin bigint, capacity int, offset int"
    full = dealt.where("length > 0").groupBy("g").applyInArrow(run, schema)
    none = rows.where("length = 0").select("*", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"))
    return full.unionByName(none).withColumnRenamed("id", id_col)
