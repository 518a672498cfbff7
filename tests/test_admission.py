"""Ordered admission and its stream against a reader that takes one document after another."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import sketch
from sievework.operators import dedup
from sievework.streaming import admission


def texts(seed, n):
    """Copies, case variants and chains in which each text differs a little from the one before."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    out = []
    while len(out) < n:
        text = words(rng.choice([40, 150, 400]))
        for _ in range(rng.choice([1, 1, 3, 6])):
            out.append(" ".join(text))
            text = list(text)
            if rng.random() < 0.8:
                text[rng.randrange(len(text))] = f"z{rng.randrange(99)}"
        if rng.random() < 0.3:
            out.append(out[-1].upper())
    rng.shuffle(out)
    return out[:n] + ["", "short", "nul\0 " + "x" * 80, None]


def sequential(signed, evaluation, distance):
    """order -> reason, from (order, norm_hash, signature) of the sound documents."""
    band = lambda s: [(s >> (16 * i)) & 0xFFFF for i in range(4)]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= distance
    admitted, out = [], {}
    for order, norm, s in sorted(signed):
        if any(norm == n for n, _ in admitted):
            out[order] = "exact_duplicate"
        elif any(near(s, x) and any(p == q for p, q in zip(band(s), band(x))) for _, x in admitted):
            out[order] = "near_duplicate"
        elif any(norm == n for n, _ in evaluation):
            out[order] = "evaluation_exact_overlap"
        elif any(near(s, x) for _, x in evaluation):
            out[order] = "evaluation_near_overlap"
        else:
            out[order] = None
            admitted.append((norm, s))
    return out


@pytest.mark.parametrize("hashing", ["blake2b", "sha"])
@pytest.mark.parametrize("distance", [3, 8])
def test_admission_is_what_a_one_pass_reader_does(spark, hashing, distance):
    docs = spark.createDataFrame(list(enumerate(texts(distance, 150))), "ord long, text string").repartition(5)
    evaluation = dedup.signatures(docs.where("ord % 37 = 5 and ord < 140"), hashing=hashing).select("norm_hash", "signature")
    got = {r["ord"]: r.reason for r in dedup.admit(docs, distance=distance, evaluation=evaluation, hashing=hashing).collect()}
    signed = [tuple(r) for r in dedup.signatures(docs.where(dedup.structural_reason(F.col("text")).isNull() & F.col("text").isNotNull()), hashing=hashing).collect()]
    want = sequential(signed, [tuple(r) for r in evaluation.collect()], distance)
    assert len(got) == 154 and {k: v for k, v in got.items() if k in want} == want
    assert all(got[k] is not None for k in got if k not in want)
    assert {"exact_duplicate", "near_duplicate", "evaluation_exact_overlap", None} <= set(want.values())


def test_chain_a_b_c(spark):
    """c is near b only; b is refused for a, so c is admitted."""
    rows = [(1, "n1", 0b0), (2, "n2", 0b111), (3, "n3", 0b111111)]
    edges = dedup.near_signatures(spark.createDataFrame(rows, "ord long, norm_hash string, signature long"), 3)
    assert {(r.a, r.b) for r in edges.collect()} == {(0, 0b111), (0b111, 0b111111)}
    refused = dedup._refused(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "earlier long, later long"))
    assert sorted(r.later for r in refused.collect()) == [2, 4]


def test_a_stream_in_batches_equals_one_pass(spark, tmp_path):
    rows = list(enumerate(texts(5, 90)))
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : (i + 1) * 30 + 4 * (i == 2)], "ord long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ord long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    names = [f"{tmp_path}/{x}" for x in ("index", "out", "checkpoint")]
    admission.admit_stream(stream, *names).trigger(availableNow=True).start().awaitTermination()
    judged = spark.read.parquet(names[1])
    assert judged.select("batch").distinct().count() == 3
    batch = {r["ord"]: r.batch for r in judged.collect()}
    got = {r["ord"]: r.reason for r in judged.collect()}
    signed = [tuple(r) for r in dedup.signatures(spark.createDataFrame(rows, "ord long, text string").where(dedup.structural_reason(F.col("text")).isNull() & F.col("text").isNotNull())).collect()]
    want = sequential([((batch[o], o), n, s) for o, n, s in signed], [], 3)
    assert {o: got[o] for o, _, _ in signed} == {o: v for (_, o), v in want.items()}
    # A stream that starts again has nothing left to do.
    admission.admit_stream(stream, *names).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(names[1]).count() == len(rows)


def test_distinct_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "ord long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = admission.distinct_stream(spark.readStream.schema("ord long, text string").parquet(f"{tmp_path}/in"))
    rows.writeStream.format("memory").queryName("distinct_rows").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.table("distinct_rows").collect()) == ["a", "b"]


def test_fixtures_with_whole_numbers_as_ids(spark):
    fixtures = spark.createDataFrame([(7, "def f(x):", "return x"), (12, "other", "quite another")], "id long, prompt string, reference string")
    training = spark.createDataFrame([(1, "def f(x):"), (2, None)], "ord long, text string")
    with pytest.raises(ValueError, match="7"):
        dedup.require_uncontaminated(fixtures, training)
    dedup.require_uncontaminated(fixtures.where("id = 12"), training)
    assert dedup.contamination(fixtures, training).first().exact_ids == [7]


def test_signature_of_one_text():
    assert sketch.simhash_of("") == -1 and sketch.simhash_of("A  b c") == sketch.simhash_of("a b\nC")
