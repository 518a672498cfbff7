import random

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import near_dedup, textvec


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def changed(rng, text, share):
    return [w if rng.random() > share else f"z{rng.randrange(9999)}" for w in text]


def corpus(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = words(rng, rng.choice([6, 30, 200]))
        out.append(" ".join(base))
        out += [" ".join(changed(rng, base, rng.choice([0.0, 0.02, 0.06, 0.3]))) for _ in range(rng.randrange(6))]
    return out + ["", "...", "one", "One", "one two", "one two", "tail passage that many share in every document here"] + [f"{a} passage that many share in every document here" for a in ("x", "y")]


def plain_sets(texts):
    out = []
    for t in texts:
        w = [x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
        out.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def plain_groups(texts, threshold=0.5):
    sets, up = plain_sets(texts), list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]):
                pairs.append((j, i))
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], pairs


def test_shingles_are_word_trigrams():
    texts = corpus()
    data, offs = textvec.utf8(pa.array(texts))
    element, first = near_dedup.shingles(data, offs)
    for i, s in enumerate(plain_sets(texts)):
        assert len(set(element[first[i] : first[i + 1]].tolist())) == len(s)


@pytest.mark.parametrize("n", [1, 2, 10, 300, 5000])
def test_every_coordinate_fills_and_estimates_jaccard(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    other = np.concatenate([base[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)])
    both = near_dedup.sketch(np.concatenate([base, other]), np.array([0, n, 2 * n]), 160)
    assert (both != np.iinfo(np.uint64).max).all()
    true = len(set(base.tolist()) & set(other.tolist())) / len(set(base.tolist()) | set(other.tolist()))
    assert abs((both[0] == both[1]).mean() - true) < 0.15
    twice = near_dedup.sketch(np.concatenate([base[::-1], base]), np.array([0, 2 * n]), 160)
    assert (twice[0] == both[0]).all()  # a set: neither order nor repeats count


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_components_are_exact(threshold):
    texts = [t for t in corpus(4) if plain_sets([t])[0]]
    rng = random.Random(2)
    base = words(rng, 80)
    texts += [" ".join(changed(rng, base, 0.05)) for _ in range(120)]  # a hot group
    data, offs = textvec.utf8(pa.array(texts))
    element, first = near_dedup.shingles(data, offs)
    got = near_dedup.components([np.unique(element[a:b]) for a, b in zip(first[:-1], first[1:])], threshold)
    assert got == plain_groups(texts, threshold)[0]


def test_groups_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id // 3: r for r in near_dedup.find_near(docs).collect()}
    want, pairs = plain_groups(texts)
    found = sum(got[a].group_id == got[b].group_id for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    for i in range(len(texts)):  # nothing is joined that brute force leaves apart
        assert want[got[i].group_id // 3] == want[i]
        assert got[i].keep == (got[i].group_id == 3 * i)
    assert got[len(texts) - 9].keep and got[len(texts) - 8].keep  # without words


def test_edges(spark):
    schema = "doc_id long, text string, __node string, __root int, key long"
    long = " ".join(words(random.Random(7), 30_000, 10**6))
    rows = [(1, None, "a", 1, 1), (2, None, None, 1, 1), (3, "", None, 2, 1), (4, "", None, 2, 1), (5, long, "l", None, None), (6, long + " end", None, 0, 0), (None, "some words of a text", "n", 1, 1), (7, "some words of a text", "n", 1, 1), (8, "twice twice again", "t", 5, 5), (8, "twice twice again", "t", 5, 5)]
    docs = spark.createDataFrame(rows, schema)
    kept = near_dedup.drop_near(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[3], rows[4], rows[7], rows[8]], key=str)
    marks = near_dedup.find_near(docs).toPandas()
    assert len(marks) == len(rows) and marks.keep.sum() == 7
    assert marks[marks.doc_id.isna()].group_id.item() == 7
    assert near_dedup.drop_near(docs.limit(0)).count() == 0 and near_dedup.find_near(docs.limit(0)).count() == 0
