"""Numeric functions of a decoder that are expressible over tables: masks, schedules, sampling filters, norms, rotations, attention."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.sources.storage import written


def attention_mask(spark: SparkSession, length: int, window: int | None = None) -> DataFrame:
    """(q, k) pairs that may attend: no key after the query, and none before its window."""
    reach = length if window is None else window
    return spark.range(length).select(F.col("id").alias("q"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("id") - (reach - 1)), F.col("id"))).alias("k"))


def learning_rate(step: Column, updates: int, warmup: int, most: float, least: float) -> Column:
    """Linear warm-up, then a cosine down to `least` at the last update (updates are numbered from 1)."""
    span = updates - warmup - 1
    done = (step - warmup - 1) / span if span > 0 else F.lit(1.0)
    return F.when(step <= warmup, step * (most / max(1, warmup))).otherwise(least + (most - least) * 0.5 * (1 + F.cos(done * math.pi)))


def next_tokens(sequences: DataFrame) -> DataFrame:
    """(seq_id, pos, token, target) of (seq_id, pos, token); the last position has no target."""
    return sequences.withColumn("target", F.lead("token").over(Window.partitionBy("seq_id").orderBy("pos"))).where("target is not null")


def token_loss(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """(seq_id, pos, nll): log-sum-exp of (seq_id, pos, token, logit) minus the target's logit."""
    top = logits.groupBy("seq_id", "pos").agg(F.max("logit").alias("m"))
    total = logits.join(top, ["seq_id", "pos"]).groupBy("seq_id", "pos").agg((F.first("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m"))))).alias("z"))
    hit = logits.join(targets.select("seq_id", "pos", F.col("target").alias("token")), ["seq_id", "pos", "token"])
    return hit.join(total, ["seq_id", "pos"]).select("seq_id", "pos", (F.col("z") - F.col("logit")).alias("nll"))


def greedy(logits: DataFrame, by: str) -> DataFrame:
    """(by, token): the greatest logit; of equal ones the least token."""
    return logits.groupBy(by).agg(F.max(F.struct(F.col("logit"), (-F.col("token")).alias("t"))).alias("x")).select(by, (-F.col("x.t")).alias("token"))


def top_k(logits: DataFrame, by: str, k: int, temperature: float = 1.0) -> DataFrame:
    """Rows whose scaled logit is the k-th greatest or more; ties at the threshold stay."""
    scaled = logits.withColumn("logit", F.col("logit") / temperature)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("logit").desc()))
    edge = scaled.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(by).agg(F.min("logit").alias("__e"))
    return scaled.join(edge, by).where(F.col("logit") >= F.col("__e")).drop("__e")


def top_p(logits: DataFrame, by: str, p: float) -> DataFrame:
    """Rows before which less than p of the probability lies; the one that crosses p stays. Adds `probability`."""
    top = F.max("logit").over(Window.partitionBy(by))
    weighted = logits.withColumn("__w", F.exp(F.col("logit") - top))
    share = weighted.withColumn("probability", F.col("__w") / F.sum("__w").over(Window.partitionBy(by)))
    before = Window.partitionBy(by).orderBy(F.col("logit").desc(), "token").rowsBetween(Window.unboundedPreceding, -1)
    return share.withColumn("__b", F.coalesce(F.sum("probability").over(before), F.lit(0.0))).where(F.col("__b") < p).drop("__b", "__w")


def rms_norm(vector: Column, epsilon: float = 1e-5) -> Column:
    """The vector over its root mean square."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    mean = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x) / F.size(vector)
    return F.transform(wide, lambda x: x / F.sqrt(mean + epsilon))


def rotate(vector: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Rotary positions: pairs of a vector's two halves turned by angles that fall with the dimension."""
    half = F.floor(F.size(vector) / 2).cast("int")
    angle = lambda i: position / F.pow(F.lit(theta), i * 2.0 / F.size(vector))
    low = F.transform(F.slice(vector, F.lit(1), half), lambda x, i: x * F.cos(angle(i)) - F.element_at(vector, i + half + 1) * F.sin(angle(i)))
    high = F.transform(F.slice(vector, half + 1, half), lambda x, i: x * F.cos(angle(i)) + F.element_at(vector, i + 1) * F.sin(angle(i)))
    return F.concat(low, high)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled with zeros, and their lengths: -1 where a vector or one of its elements is null."""
    lists = vectors.combine_chunks()
    lists = lists.cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    size[lists.is_null().to_numpy(zero_copy_only=False)] = -1
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _products(queries: pa.Table, keys: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The scaled products of two blocks, and where there is none, for lengths differ or something is null."""
    (a, m), (b, n) = _matrix(queries["vector"]), _matrix(keys["vector"])
    width = min(a.shape[1], b.shape[1])
    with np.errstate(all="ignore"):
        return (a[:, :width] @ b[:, :width].T) * scale, (m[:, None] != n[None, :]) | (m < 0)[:, None]


def attention(queries: DataFrame, keys: DataFrame, scale: float, block: int = 1024) -> DataFrame:
    """(q, k, weight): softmax over each query's keys of the scaled products; queries (q, part, vector), keys (k, part, vector) meet within a part.

    Vectors lie in blocks of about `block` of one part. Each pair of blocks is multiplied in a group of its own, first for every query's greatest
    score and its sum, then for the weights: what is shuffled are vectors, never pairs, and a task holds one pair of blocks.
    """

    def placed(rows: DataFrame, into: str) -> DataFrame:
        # The numbers aren't the same if a task runs again, hence the table.
        rows = rows.where("part is not null")
        n = rows.groupBy("part").agg(F.ceil(F.count("*") / block).alias(f"n{into}"))
        return written(rows.join(n, "part").withColumn(into, F.pmod(F.monotonically_increasing_id(), F.col(f"n{into}"))), "attention")

    left, right = placed(queries, "a"), placed(keys, "b")
    blocks = right.select("part", "nb").distinct(), left.select("part", "na").distinct()
    spread = right.join(blocks[1], "part").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1))).select("k", "vector", "part", "a", "b").groupBy("part", "a", "b")

    def met(rows: DataFrame, columns: list[str]):  # noqa: ANN202
        each = rows.join(blocks[0], "part").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        return each.select(*columns, "vector", "part", "a", "b").groupBy("part", "a", "b").cogroup(spread)

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"q": x["q"].slice(0, 0), "m": pa.array([], pa.float64()), "z": pa.array([], pa.float64())})
        s, no = _products(x, y, scale)
        with np.errstate(all="ignore"):
            m = np.where(no, -np.inf, s).max(axis=1)
            z = np.where(no, 0.0, np.exp(s - m[:, None])).sum(axis=1)
        none = no.all(axis=1)
        return pa.table({"q": x["q"], "m": pa.array(m, mask=none), "z": pa.array(z, mask=none)})

    def weights(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"q": x["q"].slice(0, 0), "k": y["k"].slice(0, 0), "weight": pa.array([], pa.float64())})
        s, no = _products(x, y, scale)
        m, z = (pc.fill_null(x[c], 0.0).to_numpy()[:, None] for c in ("m", "z"))
        with np.errstate(all="ignore"):
            w = np.exp(s - m) / z
        at = np.arange(x.num_rows).repeat(y.num_rows), np.tile(np.arange(y.num_rows), x.num_rows)
        return pa.table({"q": x["q"].take(pa.array(at[0])), "k": y["k"].take(pa.array(at[1])), "weight": pa.array(w.ravel(), mask=no.ravel())})

    kind, other = queries.schema["q"].dataType.simpleString(), keys.schema["k"].dataType.simpleString()
    parts = written(met(left, ["q"]).applyInArrow(sums, f"q {kind}, m double, z double"), "attention-sums")
    most = parts.groupBy(F.col("q").alias("of")).agg(F.max("m").alias("most"))
    both = parts.join(most, F.col("q").eqNullSafe(F.col("of")))
    total = both.groupBy("of").agg(F.max("most").alias("m"), F.sum(F.when(F.col("m") == F.col("most"), F.col("z")).otherwise(F.col("z") * F.exp(F.col("m") - F.col("most")))).alias("z"))
    told = left.join(total, F.col("q").eqNullSafe(F.col("of")))
    return met(told, ["q", "m", "z"]).applyInArrow(weights, f"q {kind}, k {other}, weight double")


def counting_batch(spark: SparkSession, batch: int, length: int, vocabulary: int) -> DataFrame:
    """(i, j, token) of a pattern that a model can learn: counting, from another number in each row."""
    i, j = F.col("i"), F.col("j")
    rows = spark.range(batch).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("j"))
    return rows.select("i", "j", ((i % (vocabulary - 1) + j) % (vocabulary - 1) + 1).alias("token"))


def kv_head(head: Column, heads: int, kv_heads: int) -> Column:
    """The key and value head that a query head shares."""
    return F.floor(head / (heads // kv_heads))
