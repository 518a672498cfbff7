"""First-fit decreasing with a tournament tree of bin capacities, run independently in random groups of documents.

A document's length is its number of UTF-8 bytes plus one, the ids of a byte-level tokenizer and an end mark. What
exceeds a bin is cut: full bins first, then a rest that is packed like a document. Groups are drawn by a seeded hash of
the id and the text's hash, about `group_size` documents each, so their number grows with the table and no
group does; only ids and lengths are moved.

Defined results: in a group, pieces are taken by length (greatest first), then id (null last), then part, and each
goes into the first bin with room. A null text has no tokens and is in no bin (one row with null bin and length 0); an
empty text has its end mark only. A text longer than a bin fills as many bins as it needs; ids are whole numbers and come back as they
are, beside nulls too. Rows that repeat id and text are packed each, in one group. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tournament:
    """Bins in order of opening; each inner node has the greatest room below it, so the first bin with room is found in log n."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for `length`, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < length:
                at += 1
        left = room[at] - length
        bin_, had = at - self.leaves, room[at]
        room[at] = left
        while at > 1:
            at >>= 1
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (none above the capacity), taken in the order given, which is decreasing."""
    tree = Tournament(len(lengths), capacity)
    placed = [tree.place(int(n)) for n in lengths]
    out = np.array(placed, np.int64).reshape(-1, 2)
    return out[:, 0], capacity - out[:, 1]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, group_size: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, part, group_id, bin_id, bin_offset, length) for each piece of each document."""
    if capacity < 1 or group_size < 1:
        raise ValueError("capacity and group_size are 1 at least")
    groups = max(1, -(-docs.count() // group_size))
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce((F.octet_length(text) + 1).cast("long"), F.lit(0).cast("long")).alias("n"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.xxhash64(text)), F.lit(groups)).alias("group_id"),
    )

    def pack(table: pa.Table) -> pa.Table:
        n, ids = table.column("n").to_numpy(), table.column("doc_id").combine_chunks()
        null, key = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        parts = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(capacity, n[row] - part * capacity)
        order = np.lexsort((part, n[row], key[row], null[row], -length))
        order = order[length[order] > 0]
        bins, offset, none = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), length == 0
        bins[order], offset[order] = first_fit_decreasing(length[order], capacity)
        group = np.full(len(row), table.column("group_id")[0].as_py())
        columns = [pa.array(key[row], mask=null[row]), pa.array(part, pa.int32()), pa.array(group), pa.array(bins, mask=none), pa.array(offset, mask=none), pa.array(length)]
        return pa.table(columns, names=["doc_id", "part", "group_id", "bin_id", "bin_offset", "length"])

    # Named partitions, since Spark would take the few bytes of all groups together as one task.
    tasks = min(groups, max(3 * docs.sparkSession.sparkContext.defaultParallelism, groups // 8))
    return rows.repartition(tasks, "group_id").groupBy("group_id").applyInArrow(pack, "doc_id long, part int, group_id long, bin_id long, bin_offset long, length long")
