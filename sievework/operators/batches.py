"""Deterministic, resumable orders of sequences and the batches cut from them."""

from __future__ import annotations

import hashlib
import random
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.ordering import numbered


def epoch_order(sequences: DataFrame, index: str, seed: int, epoch: int) -> DataFrame:
    """sequences with `position`: ordered by the hash of seed, epoch and index, then by index."""
    key = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(index).cast("string")), 256)
    return numbered(sequences.withColumn("__h", key), ["__h", index], "position").drop("__h")


def batched(ordered: DataFrame, size: int, position: str = "position", drop_last: bool = False) -> DataFrame:
    """ordered with `batch` and `slot`."""
    out = ordered.withColumns({"batch": F.floor(F.col(position) / size), "slot": F.col(position) % size})
    if drop_last:
        whole = out.groupBy("batch").agg(F.count("*").alias("__n")).where(F.col("__n") == size).select("batch")
        out = out.join(whole, "batch", "left_semi")
    return out


def of_worker(sequences: DataFrame, worker: int, workers: int, index: str = "seq_id") -> DataFrame:
    """Every workers-th sequence."""
    if not 0 <= worker < workers:
        raise ValueError("worker lies between 0 and workers - 1")
    return sequences.where(F.col(index) % workers == worker)


def cyclic(position: Column, size: int) -> Column:
    return position % size


def _generator(text: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))


def shard_order(shards: int, seed: int, epoch: int) -> list[int]:
    order = list(range(shards))
    _generator(f"{seed}:{epoch}:shards").shuffle(order)
    return order


def row_order(rows: int, seed: int, epoch: int, shard: int) -> list[int]:
    order = list(range(rows))
    _generator(f"{seed}:{epoch}:{shard}").shuffle(order)
    return order


@dataclass(frozen=True)
class Cursor:
    """Where a reader of shards stands, and its policy. A cursor of another policy is refused."""

    seed: int
    shuffle: bool = True
    epoch: int = 0
    shard: int = 0
    row: int = 0

    def state(self) -> dict[str, int | bool]:
        return {"version": 2, **asdict(self)}

    def restored(self, state: dict[str, int | bool]) -> Cursor:
        if state.get("version") != 2 or state["seed"] != self.seed or state["shuffle"] != self.shuffle:
            raise ValueError("the cursor has another policy")
        return Cursor(**{k: v for k, v in state.items() if k != "version"})  # type: ignore[arg-type]

    def take(self, sizes: list[int], count: int) -> tuple[list[tuple[int, int, int]], Cursor]:
        """The next `count` places (epoch, shard, row) over shards of these sizes, going on through epochs; and the cursor behind them."""
        if not any(sizes):
            raise ValueError("there are no sequences")
        out: list[tuple[int, int, int]] = []
        epoch, at, row = self.epoch, self.shard, self.row
        while len(out) < count:
            shards = shard_order(len(sizes), self.seed, epoch) if self.shuffle else list(range(len(sizes)))
            while at < len(shards) and len(out) < count:
                shard = shards[at]
                rows = row_order(sizes[shard], self.seed, epoch, shard) if self.shuffle else list(range(sizes[shard]))
                take = rows[row : row + count - len(out)]
                out += [(epoch, shard, r) for r in take]
                row += len(take)
                if row >= len(rows):
                    at, row = at + 1, 0
            if at >= len(shards):
                epoch, at, row = epoch + 1, 0, 0
        return out, Cursor(self.seed, self.shuffle, epoch, at, row)


def resume(ordered: DataFrame, done: int, position: str = "position") -> DataFrame:
    """What a reader that has read `done` sequences still has to read."""
    return ordered.where(F.col(position) >= done)


def shuffled_rows(sequences: DataFrame, seed: int, epoch: int) -> DataFrame:
    """(shard, seq_id, order_in_shard) of sequences (shard, seq_id), each shard shuffled by its own generator."""
    import pandas as pd

    def shuffle(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, shard = sorted(pdf["seq_id"]), int(pdf["shard"].iloc[0])
        order = row_order(len(ids), seed, epoch, shard)
        return pd.DataFrame({"shard": shard, "seq_id": [ids[i] for i in order], "order_in_shard": range(len(ids))})

    return sequences.groupBy("shard").applyInPandas(shuffle, "shard long, seq_id long, order_in_shard long")


def batch_violations(batch: DataFrame, vocabulary: int, length: int) -> DataFrame:
    """(batch, violation) of rows (batch, token_ids, loss_mask): lengths, ids outside the vocabulary, no target after the shift."""
    bad_length = (F.size("token_ids") != length) | (F.size("loss_mask") != length)
    bad_id = F.exists("token_ids", lambda x: (x < 0) | (x >= vocabulary))
    targets = F.size(F.filter(F.slice("loss_mask", 2, max(1, length - 1)), lambda m: m))
    seen = batch.groupBy("batch").agg(F.bool_or(bad_length).alias("l"), F.bool_or(bad_id).alias("i"), F.sum(targets).alias("t"))
    reason = F.when(F.col("l"), "length").when(F.col("i"), "token_id").when(F.col("t") < 1, "no_target")
    return seen.select("batch", reason.alias("violation")).where("violation is not null")
