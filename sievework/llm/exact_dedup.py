"""Exact dedup by an extendible-hash index: owner tasks take ranges of the hash, chain collisions and compare bytes.

A document's key is the 64-bit hash of its text. Keys are split into ranges of equal width, one owner each for `rows_per_owner` rows
or `bytes_per_owner` bytes of text, whichever makes more, so that
one shuffle brings all copies together, in the order of the ids. The owner's directory doubles when a bucket
of the greatest depth overflows; entries of one hash that no split can part form a chain, and a text is a copy only if
its bytes equal those of an entry of the chain. Hashes that more rows, or bytes, have than an owner takes are spread over several tasks first, each of which
does the same with its share; only what is no copy there goes on to the owner, so a text that a third of all rows hold is no task's burden. Each owner leaves its directory, buckets and chains as a file in the
shared folder (written aside, then renamed, so a task that is run twice does no harm); `ExtendibleIndex.load` opens it.

Defined results: of equal texts the one with the least id stays; a null id counts as the greatest. Of rows that
repeat id and text one stays. A null text is no copy of anything and stays; empty texts are copies of one another. Case
and white space matter. Texts of any length are compared whole. Ids are whole numbers. Other columns take no part and are returned as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textvec
from sievework.llm.shared import fresh, open_fs, written


def _spread(h: int) -> int:
    """Mixes a hash, so that its lowest bits, which the directory takes, differ wherever any bit does."""
    h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


class ExtendibleIndex:
    """64-bit hashes to chains of entry numbers; buckets split, and the directory doubles, as they fill."""

    def __init__(self, bucket_size: int = 64) -> None:
        self.bucket_size = bucket_size
        self.depth = 0
        self.buckets: list[dict[int, int]] = [{}]  # hash to the head of its chain
        self.local = [0]
        self.directory = [0]
        self.next: list[int] = []  # per entry, the next of its chain or -1
        self.keys: list[int | None] = []  # per entry, the document's id

    def chain(self, h: int) -> Iterator[int]:
        """The entries with this hash."""
        entry = self.buckets[self.directory[_spread(h) & ((1 << self.depth) - 1)]].get(h, -1)
        while entry >= 0:
            yield entry
            entry = self.next[entry]

    def add(self, h: int, key: int | None) -> int:
        """Append an entry to its hash's chain; gives its number."""
        entry = len(self.next)
        self.keys.append(key)
        while True:
            at = self.directory[_spread(h) & ((1 << self.depth) - 1)]
            bucket = self.buckets[at]
            if h in bucket or len(bucket) < self.bucket_size:
                self.next.append(bucket.get(h, -1))
                bucket[h] = entry
                return entry
            self._split(at)

    def _split(self, at: int) -> None:
        depth = self.local[at]
        if depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        old, bit, new = self.buckets[at], 1 << depth, len(self.buckets)
        self.buckets[at] = {h: e for h, e in old.items() if not _spread(h) & bit}
        self.buckets.append({h: e for h, e in old.items() if _spread(h) & bit})
        self.local[at] = depth + 1
        self.local.append(depth + 1)
        start = _spread(next(iter(old))) & (bit - 1)
        for slot in range(start | bit, len(self.directory), bit << 1):
            self.directory[slot] = new

    def save(self, uri: str, owner: int) -> None:
        """Write the index as the owner's file: aside, then renamed."""
        sizes = [len(b) for b in self.buckets]
        keys = np.array([-1 if k is None else k for k in self.keys], np.int64)
        raw = io.BytesIO()
        np.savez(
            raw, depth=self.depth, directory=np.array(self.directory, np.int32), local=np.array(self.local, np.int8), sizes=np.array(sizes, np.int32),
            hashes=np.array([h for b in self.buckets for h in b], np.uint64), heads=np.array([e for b in self.buckets for e in b.values()], np.int32),
            chain=np.array(self.next, np.int32), keys=keys, no_key=np.array([k is None for k in self.keys], bool),
        )
        where, path = open_fs(uri)
        where.create_dir(path, recursive=True)
        aside = f"{path}/.{owner}-{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as out:
            out.write(raw.getvalue())
        where.move(aside, f"{path}/owner-{owner:08d}.npz")

    @classmethod
    def load(cls, uri: str, owner: int) -> ExtendibleIndex:
        """Open the owner's file."""
        where, path = open_fs(uri)
        with where.open_input_file(f"{path}/owner-{owner:08d}.npz") as file:
            z = np.load(io.BytesIO(file.read()))
            index = cls()
            index.depth, index.directory, index.local = int(z["depth"]), z["directory"].tolist(), z["local"].tolist()
            cut = np.concatenate([[0], np.cumsum(z["sizes"])])
            hashes, heads = z["hashes"].tolist(), z["heads"].tolist()
            index.buckets = [dict(zip(hashes[i:j], heads[i:j])) for i, j in zip(cut[:-1], cut[1:])]
            index.next = z["chain"].tolist()
            index.keys = [None if no else k for k, no in zip(z["keys"].tolist(), z["no_key"].tolist())]
        return index


def _decide(batches: Iterator[pa.RecordBatch], uri: str | None, bucket_size: int) -> Iterator[tuple[pa.RecordBatch, list, list[int]]]:
    """For each batch, each row's (keeper's id, is a copy), and the number of the keeper's entry. Rows come by owner, in the order of the ids. Without a folder nothing is saved."""
    index, owner, bodies = ExtendibleIndex(bucket_size), None, []
    for batch in batches:
        data, offs = textvec.utf8(batch.column("__text"))
        owners, hashes, ids = (batch.column(c).to_pylist() for c in ("__owner", "__hash", "__id"))
        found, entries = [], []
        for i, (own, h, key) in enumerate(zip(owners, hashes, ids)):
            if own != owner:
                if uri and owner is not None and owner >= 0:
                    index.save(uri, owner)
                index, owner, bodies = ExtendibleIndex(bucket_size), own, []
            if own < 0:
                found.append((key, False))
                entries.append(-1)
                continue
            h &= 0xFFFFFFFFFFFFFFFF
            body = data[offs[i] : offs[i + 1]].tobytes()
            keeper = next((e for e in index.chain(h) if bodies[e] == body), -1)
            if keeper < 0:
                entries.append(index.add(h, key))
                bodies.append(body)
                found.append((key, False))
            else:
                entries.append(keeper)
                found.append((index.keys[keeper], True))
        yield batch, found, entries
    if uri and owner is not None and owner >= 0:
        index.save(uri, owner)


def _hashed(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    row = [F.struct("*").alias("__row")] if whole else []
    packed = docs.select(*row, F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return packed.withColumn("__hash", F.xxhash64("__text"))


def _owners(docs: DataFrame, text_col: str, rows_per_owner: int, bytes_per_owner: int) -> int:
    """How many owners the rows and their texts need."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    return max(1, -(-size["rows"] // rows_per_owner), -(-(size["bytes"] or 0) // bytes_per_owner))


def _parted(rows: DataFrame, rows_per_owner: int, bytes_per_owner: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of all but hot hashes, and those of hot ones by the task (__owner) that sees them first; None where no hash is hot.

    A hash is hot if several rows have it and more of them, or of their bytes, than an owner takes; so there is one hot hash for each `rows_per_owner` rows
    and one for each `bytes_per_owner` bytes at most, 16 bytes each, and they are broadcast.
    """
    counts = rows.where("__text is not null").groupBy("__hash").agg(F.count("*").alias("rows"), F.sum(F.octet_length("__text")).alias("bytes"))
    need = F.least("rows", F.greatest(F.ceil(F.col("rows") / rows_per_owner), F.ceil(F.col("bytes") / bytes_per_owner)))
    hot = written(counts.select("__hash", need.alias("__n")).where("__n > 1"), "exact-hot")
    tasks = hot.agg(F.sum("__n").alias("n")).first()["n"]
    if not tasks:
        return rows, None
    share = F.pmod(F.xxhash64("__id", F.spark_partition_id()), F.col("__n"))
    mine = rows.join(F.broadcast(hot), "__hash").withColumn("__share", share)
    mine = mine.withColumn("__owner", F.xxhash64("__hash", "__share").bitwiseAND(F.lit((1 << 63) - 1))).drop("__n", "__share")
    spread = mine.repartition(int(tasks), "__owner").sortWithinPartitions("__owner", F.col("__id").asc_nulls_last())
    return rows.join(F.broadcast(hot), "__hash", "left_anti"), spread


def _owned(rows: DataFrame, owners: int) -> DataFrame:
    """Rows by owner. Null texts need none; they spread by id. An owner is a partition."""
    # The top 31 bits, scaled to the number of owners: ranges of equal width.
    owner = F.when(F.col("__null"), F.lit(-1)).otherwise(F.shiftrightunsigned("__hash", 33) * owners / F.lit(1 << 31)).cast("long")
    spread = rows.withColumn("__owner", owner).drop("__null")
    place = F.when(F.col("__owner") < 0, F.pmod(F.xxhash64("__id", F.spark_partition_id()), F.lit(owners))).otherwise(F.col("__owner")).cast("int")
    return spread.repartitionById(owners, place).sortWithinPartitions("__owner", F.col("__id").asc_nulls_last())


def find_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_owner: int = 20_000, bytes_per_owner: int = 64 << 20, bucket_size: int = 64) -> DataFrame:
    """(doc_id, keeper_id, is_copy) for each row of docs."""
    owners, uri = _owners(docs, text_col, rows_per_owner, bytes_per_owner), fresh(docs.sparkSession, "exact-index")
    cold, hot = _parted(_hashed(docs, id_col, text_col, False), rows_per_owner, bytes_per_owner)
    rows = cold.select("__id", "__text", "__hash", F.lit(None).cast("long").alias("__task"), F.lit(None).cast("long").alias("__entry"))
    local = None
    if hot is not None:

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found, entries in _decide(batches, None, bucket_size):
                text = pc.if_else(pa.array([c for _, c in found], pa.bool_()), None, batch.column("__text"))
                yield pa.RecordBatch.from_arrays([batch.column("__id"), text, batch.column("__hash"), batch.column("__owner"), pa.array(entries, pa.int64())], names=["__id", "__text", "__hash", "__task", "__entry"])

        local = written(hot.select("__id", "__text", "__hash", "__owner").mapInArrow(share, "__id long, __text string, __hash long, __task long, __entry long"), "exact-shares")
        rows = rows.union(local.where("__text is not null"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, _ in _decide(batches, uri, bucket_size):
            keeper = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), keeper, pa.array([c for _, c in found], pa.bool_()), batch.column("__task"), batch.column("__entry")], names=["doc_id", "keeper_id", "is_copy", "__task", "__entry"])

    marked = _owned(rows.withColumn("__null", F.col("__text").isNull()), owners).mapInArrow(mark, "doc_id long, keeper_id long, is_copy boolean, __task long, __entry long")
    if local is None:
        return marked.drop("__task", "__entry")
    marked = written(marked, "exact-marked")
    told = marked.where("__task is not null").select("keeper_id", "__task", "__entry")
    rest = local.where("__text is null").join(told, ["__task", "__entry"]).select(F.col("__id").alias("doc_id"), "keeper_id", F.lit(True).alias("is_copy"))
    return marked.drop("__task", "__entry").union(rest)


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_owner: int = 20_000, bytes_per_owner: int = 64 << 20, bucket_size: int = 64) -> DataFrame:
    """docs without the copies, all columns kept."""
    owners, uri = _owners(docs, text_col, rows_per_owner, bytes_per_owner), fresh(docs.sparkSession, "exact-index")
    names, text_at = docs.columns, docs.columns.index(text_col)
    cold, hot = _parted(_hashed(docs, id_col, text_col, True), rows_per_owner, bytes_per_owner)

    def kept(batches: Iterator[pa.RecordBatch], to: str | None) -> Iterator[pa.RecordBatch]:
        def opened() -> Iterator[pa.RecordBatch]:
            for b in batches:
                row = b.column("__row")
                yield pa.RecordBatch.from_arrays([row, b.column("__id"), row.field(text_at).cast(pa.string()), b.column("__hash"), b.column("__owner")], names=["__row", "__id", "__text", "__hash", "__owner"])

        for batch, found, _ in _decide(opened(), to, bucket_size):
            yield batch.filter(pa.array([not c for _, c in found], pa.bool_()))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept(batches, None):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("__row", "__id", "__hash")], names=["__row", "__id", "__hash"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept(batches, uri):
            yield pa.RecordBatch.from_arrays(batch.column("__row").flatten(), names=names)

    rows = cold.select("__row", "__id", "__hash", F.col("__text").isNull().alias("__null"))
    if hot is not None:
        fewer = hot.select("__row", "__id", "__hash", "__owner")
        local = fewer.mapInArrow(share, fewer.select("__row", "__id", "__hash").schema).withColumn("__null", F.lit(False))
        rows = rows.union(written(local, "exact-shares"))
    return _owned(rows, owners).mapInArrow(last, docs.schema)
