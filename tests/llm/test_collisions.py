"""Texts that sums of powers modulo 2**64 can't tell apart, and hashes made equal."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, line_dedup, near_dedup, textvec


def thue_morse(n=2048):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_span_hashes_tell_texts_apart():
    rng = random.Random(1)
    texts = [*thue_morse(), "", "a", "a\0", "\0", "\0\0"] + ["".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(2000)]
    data, offs = textvec.utf8(pa.array(texts))
    for seed in (0, 5):
        h = textvec.span_hashes(data, offs[:-1], offs[1:], seed)
        assert len(set(h.tolist())) == len(set(texts))
        assert [h[texts.index(t)] for t in texts] == h.tolist()
    same = textvec.same_spans(data, offs[:-2], offs[1:-1], data, offs[1:-1], offs[2:])
    assert same.tolist() == [a == b for a, b in zip(texts, texts[1:])]


def test_near_and_line_dedup_keep_both(spark):
    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.keep for r in near_dedup.find_near(docs).collect()] == [True, True]
    for edits in (1, 2):
        assert [r.keep for r in line_dedup.find_lines(docs, edits=edits).collect()] == [True, True]


def test_line_less_a_character_is_hashed_apart(spark):
    """Variants of long alternating lines: one true pair among lines that differ everywhere."""
    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a), (2, b), (3, b[:1000] + "x" + b[1001:]), (4, a[:7] + a[8:])], "doc_id long, text string")
    got = {r.doc_id: (r.first_doc_id, r.keep) for r in line_dedup.find_lines(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False), 4: (1, False)}


def test_nodes_of_one_hash_stay_apart(spark, monkeypatch):
    prepared = near_dedup._prepared
    monkeypatch.setattr(near_dedup, "_prepared", lambda *a: prepared(*a).withColumn("__h", F.lit(5).cast("long")))
    docs = spark.createDataFrame([(1, "one text of its own"), (2, "another text of quite other words"), (3, "one text of its own")], "doc_id long, text string")
    assert {r.doc_id: r.keep for r in near_dedup.find_near(docs).collect()} == {1: True, 2: True, 3: False}
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == [1, 2]


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(bpe.compile_vocabulary())


def test_encoding_compares_bytes(automaton, monkeypatch):
    texts = [*thue_morse(), "two words here", "too words hear", "two words here"]
    data, offs = textvec.utf8(pa.array(texts))
    plain = [t.tolist() for _, _, t, _ in bpe.encode_texts(automaton, data, offs)][0]
    monkeypatch.setattr(textvec, "span_hashes", lambda data, starts, ends, seed=0: np.full(len(starts), 9, np.uint64))
    for name in ("known", "known_at", "known_n", "store", "known_start", "known_size", "known_bytes"):
        setattr(automaton, name, getattr(automaton, name)[:0])
    assert [t.tolist() for _, _, t, _ in bpe.encode_texts(automaton, data, offs)][0] == plain
    assert automaton.labels(np.array(plain)).tobytes() == "".join(texts).encode()


def test_ids_outside_the_vocabulary(automaton):
    ids = automaton.ids[[100, 300]].tolist()
    assert automaton.decode([ids[0], -1, 10**9, ids[1]]).decode() == automaton.decode(ids[:1]).decode() + "��" + automaton.decode(ids[1:]).decode()


@pytest.mark.parametrize("bits", [6, 32])
def test_the_filter_changes_nothing(spark, bits):
    rng = random.Random(3)
    base = ["a sentence of some length", "another sentence of some length", "walked in the old town"]
    rows = [(i, "\n".join(x[: k] + "x" + x[k:] if rng.random() < 0.5 else x for x in rng.choices(base, k=4) for k in [rng.randrange(20)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.find_lines(docs).collect()))
    assert sorted(map(tuple, line_dedup.find_lines(docs, filter_bits=bits if bits < 32 else 12).collect())) == want
