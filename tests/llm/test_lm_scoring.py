import itertools
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from sievework.llm import lm_scoring, textvec
import pyarrow as pa


def brute(seq, emit, pi, move):
    total = 0.0
    for path in itertools.product(range(len(pi)), repeat=len(seq)):
        p = pi[path[0]] * emit[seq[0], path[0]]
        for a, b, w in zip(path, path[1:], seq[1:]):
            p *= move[a, b] * emit[w, b]
        total += p
    return math.log(total)


def plain_counts(seqs, emit, pi, move):
    """Baum-Welch by summing over all paths."""
    emits, pairs, start = np.zeros_like(emit), np.zeros_like(move), np.zeros_like(pi)
    for seq in seqs:
        paths = []
        for path in itertools.product(range(len(pi)), repeat=len(seq)):
            p = pi[path[0]] * emit[seq[0], path[0]]
            for a, b, w in zip(path, path[1:], seq[1:]):
                p *= move[a, b] * emit[w, b]
            paths.append((p, path))
        z = sum(p for p, _ in paths)
        for p, path in paths:
            start[path[0]] += p / z
            for w, s in zip(seq, path):
                emits[w, s] += p / z
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p / z
    return emits, pairs, start


@pytest.fixture
def model():
    rng = np.random.default_rng(5)
    emit = rng.random((6, 3))
    move = rng.random((3, 3))
    pi = rng.random(3)
    return emit / emit.sum(0), pi / pi.sum(), move / move.sum(1, keepdims=True)


def test_forward_and_counts_match_enumeration(model):
    emit, pi, move = model
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 6, n) for n in (1, 2, 5, 7, 3, 3, 1, 6, 4, 2, 2, 7)]
    tokens, lens = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = [brute(s, emit, pi, move) for s in seqs]
    np.testing.assert_allclose(lm_scoring.forward(tokens, lens, emit, pi, move), want, rtol=1e-10)
    got = lm_scoring.expected(tokens, lens, emit, pi, move, np.float64)
    for a, b in zip(got[:3], plain_counts(seqs, emit, pi, move)):
        np.testing.assert_allclose(a, b, atol=1e-9)
    assert got[3] == pytest.approx(sum(want))


def test_training_raises_the_likelihood_and_ignores_blocks(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"] if i % 2 else ["ee", "ff", "gg", "hh"], 30)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = {}
    for size in (300, 10**6):
        blocks = lm_scoring.encode(docs, tokens_per_block=size)
        lik = lm_scoring.train(blocks, 2, 6, 1, 0.01, 1, 3).seen
        assert all(b > a - 1e-2 for a, b in zip(lik, lik[1:])) and lik[-1] > lik[0]
        seen[size] = lik
    np.testing.assert_allclose(seen[300], seen[10**6], rtol=1e-4)
    got = lm_scoring.score_documents(docs, states=2, iterations=6, min_count=1).toPandas()
    assert got.perplexity.mean() < 5  # two topics of four words each


def test_distributed_score_matches_a_plain_model(spark):
    """One iteration from the same start, all in plain numpy over the whole corpus."""
    texts = ["the cat sat", "the dog sat on the cat", "a cat", "zebra", "the the the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score_documents(docs, states=2, iterations=1, min_count=2, seed=9).collect()}
    data, offs = textvec.utf8(pa.array(texts))
    word, first = textvec.words(data, offs)
    vocab, tok, count = np.unique(word, return_inverse=True, return_counts=True)
    known = count >= 2
    weight = count[:, None] * lm_scoring._jitter(vocab, 2, 9)
    rare = np.full(2, count[~known].sum() / 2)
    pi, move = np.full(2, 0.5), (np.ones((2, 2)) + 2 * np.eye(2)) / 4

    def emissions(w, rare, total):
        out = (w + 0.01) / (total + 0.01 * (known.sum() + 1))
        out[~known] = (rare + 0.01) / (total + 0.01 * (known.sum() + 1))
        return out

    emit = emissions(weight, rare, weight[known].sum(0) + rare)
    lens = np.diff(first)
    emits, pairs, start, _ = lm_scoring.expected(tok, lens, emit, pi, move, np.float64)
    emit = emissions(emits, emits[~known].sum(0), emits.sum(0))
    pi, move = (start + 0.01) / (start.sum() + 0.02), (pairs + 0.01) / (pairs.sum(1, keepdims=True) + 0.02)
    want = lm_scoring.forward(tok, lens, emit, pi, move)
    np.testing.assert_allclose([got[i] for i in range(5)], want, rtol=1e-4)


def test_edges(spark):
    schema = T.StructType.fromDDL("doc_id long, text string, block string, ids string, lens int")
    rows = [(1, None, "x", None, 1), (2, "", "x", None, 1), (None, "a b", None, None, 1), (3, "...", "x", None, 1), (4, "a b", "x", None, 1), (4, "a b", "x", None, 1), (5, "w " * 60_000, "x", None, 1)]
    got = lm_scoring.score_documents(spark.createDataFrame(rows, schema), min_count=1).toPandas()
    assert len(got) == len(rows)
    none = got[got.doc_id.isin([1, 2, 3])]
    assert (none.n_tokens == 0).all() and (none.log_likelihood == 0).all() and none.perplexity.isna().all()
    assert got[got.doc_id == 4].log_likelihood.nunique() == 1
    assert got[got.doc_id == 5].n_tokens.item() == 60_000 and math.isfinite(got[got.doc_id == 5].log_likelihood.item())
    assert lm_scoring.score_documents(spark.createDataFrame([], schema)).count() == 0


def test_rare_words_share_their_symbol(spark):
    """Probabilities of all words, each a text of its own, sum to 1."""
    texts = ["the cat sat on the cat", "the", "cat", "sat", "on", "zebra", "yak", "gnu the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    one, all_ = ({r.doc_id: r.log_likelihood for r in lm_scoring.score_documents(docs, states=2, iterations=2, min_count=2, split_rare=split).collect()} for split in (True, False))
    rare = 3  # zebra, yak, gnu
    assert sum(math.exp(one[i]) for i in (1, 2, 3, 4)) + rare * math.exp(one[5]) == pytest.approx(1, rel=1e-5)
    assert one[5] == pytest.approx(all_[5] - math.log(rare), rel=1e-5) and one[0] == pytest.approx(all_[0], rel=1e-6)
