"""Preparation from end to end, shards that are read back, and refusals."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework import schema
from sievework.operators import evaluate, packs, prepare, splits
from sievework.operators.filters import Bounds
from sievework.sources import sinks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20 + i % 13)) for i in range(60)]
    return [*enumerate(texts), (60, f" {texts[7].upper()}"), (61, "short"), (62, None)]


def test_corpus_preparation(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "ord long, text string").repartition(4)
    report = prepare.prepare_corpus(docs, str(tmp_path / "out"), bounds=Bounds(10, 10_000), distance=0, validation_fraction=0.3, length=64, per_shard=8, drop_remainder=False)
    assert report["seen"] == 63 and report["admitted"] == 60 and sum(report["reasons"].values()) == 3
    back = sinks.read_shards(spark, str(tmp_path / "out"), 64)
    ids, number = schema.byte_ids(), {}
    kept = spark.createDataFrame(rows[:60], "ord long, text string").withColumn("content_hash", F.sha2("text", 256))
    for r in splits.split_documents(kept, 0.3).orderBy("ord").collect():
        number.setdefault(r.split, []).extend([ids[b] for b in r.text.encode()] + [schema.EOS])
    for split, want in number.items():
        got = [i for r in back.where(F.col("split") == split).orderBy("seq_id").collect() for i in r.token_ids[: r.non_padding_tokens]]
        assert got == want and report["splits"][split]["tokens"] == len(want)
    assert json.loads(open(glob.glob(f"{tmp_path}/out/report/part*")[0]).read()) == report
    with pytest.raises(FileExistsError):
        prepare.prepare_corpus(docs, str(tmp_path / "out"))


def test_changed_shards_are_refused(spark, tmp_path):
    sequences = spark.createDataFrame([("train", i, [3, 4, 5 + i], 3) for i in range(10)] + [("validation", 0, [9, 9, 0], 2)], "split string, seq_id long, token_ids array<int>, non_padding_tokens int")
    path = str(tmp_path / "shards")
    manifest = sinks.write_shards(sequences, path, 4)
    assert {(r.split, r.shard): (r.sequences, r.first_index, r.end_index) for r in manifest.collect()} == {("train", 0): (4, 0, 4), ("train", 1): (4, 4, 8), ("train", 2): (2, 8, 10), ("validation", 0): (1, 0, 1)}
    assert sinks.read_shards(spark, path, 3).count() == 11
    with pytest.raises(ValueError, match="length"):
        sinks.read_shards(spark, path, 4)
    found = packs.locate(spark.createDataFrame([("train", 9), ("train", -1), ("train", 10), ("train", -11), ("validation", 0)], "split string, index long"), manifest)
    assert {(r.split, r["index"]): (r.shard, r.row) for r in found.collect()} == {("train", 9): (2, 1), ("train", -1): (2, 1), ("validation", 0): (0, 0)}
    one = sequences.where("split = 'train' and seq_id = 5").withColumn("token_ids", F.array(F.lit(3), F.lit(4), F.lit(11))).withColumn("seq_id", F.lit(5).cast("long"))
    one.drop("split").coalesce(1).write.mode("append").parquet(f"{path}/tokens/split=train/shard=1")
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_shards(spark, path)
    with pytest.raises(FileExistsError):
        sinks.write_shards(sequences, path)


def test_code_preparation(spark, tmp_path):
    names = schema.DOCUMENT.names
    good = "def f(x):\n    return x + 1  # a line of some length\n"
    base = {"source_type": "code", "license": schema.LICENCES[0]}
    rows = []
    for i, (path, text, over) in enumerate([("a.py", good, {}), ("b.py", good, {}), ("vendor/c.py", good + "#1", {}), ("d.py", "-----BEGIN RSA PRIVATE KEY-----\n" + good, {}), ("e.py", "# Code generated by a tool. DO NOT EDIT.\n" + good, {}), ("", good + "#2", {}), ("f.py", "x\0" + good, {}), ("g.py", good + "#3", {"license": "none"}), ("h.py", good * 9 + "import os", {}), ("i.py", "key = 'AKIA" + "ABCDEFGHIJKLMNOP'\n" + good, {})]):
        rows.append({"ord": i, **{n: None for n in names if n != "ord"}, **base, "path": path, "text": text, **over})
    fields = ", ".join(f"{n} string" for n in dict.fromkeys(["text", "path", "source_type", "license"]))
    docs = spark.createDataFrame([(r["ord"], r["text"], r["path"], r["source_type"], r["license"]) for r in rows], f"ord long, {fields}")
    report = prepare.prepare_code(docs, str(tmp_path / "code"))
    assert report["seen"] == 10 and report["admitted"] == 2
    assert report["reasons"] == {"exact_duplicate": 1, "vendor_or_generated_path": 1, "secret_or_credential": 2, "generated": 1, "missing_path": 1, "binary_or_empty": 1, "license": 1}
    assert spark.read.json(str(tmp_path / "code" / "documents")).count() == 2


def test_functional_score_of_a_source_that_does_not_parse(spark):
    fixtures = spark.createDataFrame([("a", "completion", "x = ", "1", None, "assert x"), ("b", "completion", "x = ", "1", None, None), ("c", "completion", "x = ", "1", None, "assert x")], "id string, kind string, prompt string, reference string, suffix string, tests string")
    predictions = spark.createDataFrame([("a", "("), ("b", "("), ("c", "1")], "id string, prediction string")
    assert {r.id: r.functional for r in evaluate.score_fixtures(fixtures, predictions).collect()} == {"a": False, "b": None, "c": None}
