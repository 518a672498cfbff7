"""Exact and near dedup, evaluation overlap, and ordered admission as a fixpoint.

Order is a column. Admission is what a one-pass reader in that order does: a document is admitted unless an admitted earlier one has
its normal form, or a signature within the distance that shares a band; evaluation overlap is tested after that, and what
overlaps never blocks a later document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import sketch
from sievework.functions import text as t
from sievework.operators.filters import Bounds, structural_reason
from sievework.sources.storage import written

BANDS = 4


def first_copies(documents: DataFrame, *, order: str = "ord", text: str = "text", bounds: Bounds = Bounds(), excluded: DataFrame | None = None) -> DataFrame:
    """Structurally sound documents, the first of each content hash, without those whose hash is in `excluded` (content_hash)."""
    sound = documents.where(structural_reason(F.col(text), bounds).isNull() & F.col(text).isNotNull()).withColumn("content_hash", t.content_hash(F.col(text)))
    if excluded is not None:
        sound = sound.join(excluded.select("content_hash").distinct(), "content_hash", "left_anti")
    # Only hash and order are shuffled to find the first; the texts follow by a semi join.
    first = sound.groupBy("content_hash").agg(F.min(order).alias(order))
    return sound.join(first, ["content_hash", order], "left_semi")


def first_keys(documents: DataFrame, *, order: str = "ord", text: str = "text", bounds: Bounds = Bounds(), **measures: Column) -> DataFrame:
    """(order, content_hash, measures) of first_copies, without moving a text: measures are expressions over a document."""
    sound = documents.where(structural_reason(F.col(text), bounds).isNull() & F.col(text).isNotNull() & F.col(order).isNotNull())
    slim = sound.select(t.content_hash(F.col(text)).alias("content_hash"), F.struct(order, *(m.alias(n) for n, m in measures.items())).alias("x"))
    return slim.groupBy("content_hash").agg(F.min("x").alias("x")).select("x.*", "content_hash")


def signatures(documents: DataFrame, *, order: str = "ord", text: str = "text", hashing: str = "blake2b") -> DataFrame:
    """(order, norm_hash, signature)."""
    return documents.select(order, *_signed(text, hashing))


def _signed(text: str, hashing: str) -> list[Column]:
    """norm_hash and signature of a text column."""
    if hashing == "blake2b":
        return [t.normalized_hash(F.col(text), "python").alias("norm_hash"), sketch.simhash_blake2b(text).alias("signature")]
    if hashing != "sha":
        raise ValueError("hashing is blake2b or sha")
    return [t.normalized_hash(F.col(text)).alias("norm_hash"), sketch.simhash_words(text).alias("signature")]


def near_signatures(signature: DataFrame, distance: int, bands: int = BANDS, against: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct signatures that share a band and differ in at most `distance` bits; a < b where there is one table.

    With bands > distance no pair is lost. Distinct signatures only, so copies don't multiply out.
    """

    def banded(df: DataFrame, name: str) -> DataFrame:
        # Written first: the signatures are a UDF's, which each side, and the pruning of nulls, would run again.
        own = written(df.select("signature").distinct(), "signatures")
        return own.select(F.col("signature").alias(name)).select(name, F.posexplode(sketch.bands(F.col(name), bands)).alias("band", "value"))

    left = banded(signature, "a")
    right = left.withColumnRenamed("a", "b") if against is None else banded(against, "b")
    pairs = left.join(right, ["band", "value"])
    if against is None:
        pairs = pairs.where("a < b")
    return pairs.select("a", "b", sketch.hamming(F.col("a"), F.col("b")).alias("distance")).where(F.col("distance") <= distance).distinct()


def evaluation_overlap(signed: DataFrame, evaluation: DataFrame, distance: int) -> DataFrame:
    """signed with eval_exact and eval_near: whether an evaluation row has its norm_hash, or a signature within the distance (without banding's losses)."""
    signed = written(signed, "overlap-signed")  # the signatures are a UDF's, and used twice
    exact = evaluation.select("norm_hash").distinct().withColumn("eval_exact", F.lit(True))
    near = near_signatures(signed, distance, distance + 1, evaluation).select(F.col("a").alias("signature")).distinct().withColumn("eval_near", F.lit(True))
    no = F.lit(False)
    joined = signed.join(exact, "norm_hash", "left").join(near, "signature", "left")
    return joined.withColumns({"eval_exact": F.coalesce("eval_exact", no), "eval_near": F.coalesce("eval_near", no)})


def _refused(edges: DataFrame) -> DataFrame:
    """Nodes that the greedy pass refuses, from edges (earlier, later). Each round decides every node that waits for none."""
    spark = edges.sparkSession
    edges = written(edges, "admission-edges")
    found: list[DataFrame] = []
    while not edges.isEmpty():
        waiting = edges.select(F.col("later").alias("earlier")).distinct()
        admitted = edges.select("earlier").distinct().join(waiting, "earlier", "left_anti")
        gone = written(edges.join(admitted, "earlier", "left_semi").select("later").distinct(), "admission-refused")
        found.append(gone)
        left = edges.join(gone, "later", "left_anti").join(gone.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        edges = written(left, "admission-edges")
    if not found:
        return spark.createDataFrame([], "later long")
    return reduce(DataFrame.union, found)


def admit(
    documents: DataFrame, *, order: str = "ord", text: str = "text", bounds: Bounds = Bounds(), distance: int = 3, evaluation: DataFrame | None = None, hashing: str = "blake2b",
) -> DataFrame:
    """(order, reason) for each document; the reason is null for the admitted. evaluation has norm_hash and signature. `order` is unique."""
    if not 0 <= distance <= 8:
        raise ValueError("distance is 0 to 8")
    judged = documents.select(order, text, structural_reason(F.col(text), bounds).alias("reason"))
    judged = judged.withColumn("reason", F.when(F.col(text).isNull(), "malformed").otherwise(F.col("reason")))
    signed = signatures(judged.where("reason is null"), order=order, text=text, hashing=hashing).select(F.col(order).alias("o"), "norm_hash", "signature")
    if evaluation is not None:
        signed = evaluation_overlap(signed, evaluation, distance)
    else:
        signed = signed.withColumns({"eval_exact": F.lit(False), "eval_near": F.lit(False)})
    signed = written(signed, "admission-signed")
    pairs = written(near_signatures(signed, distance), "admission-pairs")
    # Of equal signatures only the first clean document can be admitted: the others have all its neighbours and itself besides.
    nodes = written(signed.where("not eval_exact and not eval_near").groupBy("signature").agg(F.min("o").alias("o"), F.min_by("norm_hash", "o").alias("norm_hash")), "admission-nodes")
    left, right = (nodes.select(F.col("signature").alias(c), F.col("o").alias(f"o{c}")) for c in ("a", "b"))
    edges = pairs.join(left, "a").join(right, "b").select(F.least("oa", "ob").alias("earlier"), F.greatest("oa", "ob").alias("later"))
    admitted = nodes.join(_refused(edges).select(F.col("later").alias("o")), "o", "left_anti")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).union(signed.select("signature", "signature").distinct()).toDF("signature", "other")
    nearest = both.join(admitted.select(F.col("signature").alias("other"), F.col("o").alias("near")), "other").groupBy("signature").agg(F.min("near").alias("near"))
    exact = admitted.select("norm_hash", F.col("o").alias("same"))
    told = signed.join(exact, "norm_hash", "left").join(nearest, "signature", "left").select(
        F.col("o").alias(order),
        F.when(F.col("same") < F.col("o"), "exact_duplicate").when(F.col("near") < F.col("o"), "near_duplicate").when(F.col("eval_exact"), "evaluation_exact_overlap").when(F.col("eval_near"), "evaluation_near_overlap").alias("reason"),
    )
    return told.union(judged.where("reason is not null").select(order, "reason"))


def signature_index(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables that a later run looks up: exact (norm_hash) and bands (band, value, signature). They hold no text."""
    banded = admitted.select(F.posexplode(sketch.bands(F.col("signature"))).alias("band", "value"), "signature").distinct()
    return admitted.select("norm_hash").distinct(), banded


def contamination(fixtures: DataFrame, training: DataFrame, distance: int = 3, hashing: str = "blake2b") -> DataFrame:
    """One row: sorted ids of fixtures (id, prompt, reference) whose prompt or reference the training texts (ord, text) hold, exactly or nearly, and whether there are none."""
    parts = fixtures.select("id", F.explode(F.array("prompt", "reference")).alias("text")).where("text is not null")
    # One pass over the training texts.
    seen = written(training.select(t.evaluation_hash(F.col("text")).alias("h"), _signed("text", hashing)[1]).distinct(), "training-signed")
    signed = written(parts.select("id", t.evaluation_hash(F.col("text")).alias("h"), _signed("text", hashing)[1]), "fixtures-signed")
    exact = signed.join(seen.select("h"), "h", "left_semi").select("id").distinct().withColumn("kind", F.lit("exact"))
    pairs = near_signatures(signed, distance, distance + 1, seen)
    near = signed.join(pairs.select(F.col("a").alias("signature")).distinct(), "signature", "left_semi").select("id").distinct().withColumn("kind", F.lit("near"))
    ids = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("id"))))
    return exact.union(near).agg(ids("exact").alias("exact_ids"), ids("near").alias("near_ids")).withColumn("clean", (F.size("exact_ids") == 0) & (F.size("near_ids") == 0))


def require_uncontaminated(fixtures: DataFrame, training: DataFrame) -> None:
    """Fail with the sorted ids of fixtures that the training texts hold exactly."""
    hashes = training.select(t.evaluation_hash(F.col("text")).alias("h")).distinct()
    parts = fixtures.select("id", F.explode(F.array("prompt", "reference")).alias("text"))
    found = parts.join(hashes, t.evaluation_hash(F.col("text")) == F.col("h"), "left_semi").agg(F.array_sort(F.collect_set("id")).alias("ids")).first()["ids"]
    if found:
        raise ValueError(f"the training data hold fixtures: {', '.join(map(str, found))}")
