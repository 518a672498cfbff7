import math
import random
from collections import Counter

import numpy as np
import pytest

from sievework.llm import url_filter
from sievework.llm.url_filter import Trees


def table(spark, n=1500, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        host = f"{rng.choice(['free', 'best', 'cheap'])}-{rng.choice(['deals', 'stuff', 'offers'])}-{rng.randrange(99)}.example.com" if bad else f"{rng.choice(['www.', ''])}{rng.choice(['thing', 'other', 'place'])}.example.org"
        rows.append((i, f"http://{host}/en/{i}" + ("?a=1&b=2&c=3" if bad else ""), int(not bad)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id long, quality int, toxic int")
    return pages, labels, {i: q for i, _, q in rows}


def test_learns_from_labels_and_holds_out(spark):
    pages, labels, truth = table(spark)
    got = url_filter.filter_urls(pages, labels).toPandas()
    held = got[got.page_id % 2 == 0]
    assert (held.keep == held.page_id.map(truth).astype(bool)).mean() > 0.98
    assert held.bad_score.between(0, 1).all()


def test_features(spark):
    url = "HTTPS://User@News.Site-1.co.example.com:80/en/42/a-b.html?x=1&&y=é#top"
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    rows = url_filter.parts(pages)
    got = url_filter._lexical(rows).first()
    assert (got.host, got.suffix, got.path, got.query, got.named) == ("news.site-1.co.example.com", "example.com", "/en/42/a-b.html", "x=1&&y=é", 42)
    assert (got.depth, got.parameters, got.labels, got.hyphens, got.host_hyphens, got.secure, got.has_fragment) == (3, 2, 5, 2, 1, True, True)
    n = Counter(url)
    assert got.entropy == pytest.approx(-sum(c / len(url) * math.log(c / len(url)) for c in n.values()))


def test_only_labels_label(spark):
    pages = spark.createDataFrame([(1, "http://casino-win.org/x"), (2, "http://casinos.org/x"), (3, "http://a.org/en/5"), (4, "http://a.org/en/6"), (5, None), (6, "http://a.org/en/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (6, 1, 0), (6, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.bad for r in url_filter.label_urls(url_filter.parts(pages), labels).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 0, 5: None, 6: None}


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    trees = Trees.fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert abs(trees.predict(x[2000:]).mean() - y[2000:].mean()) < 0.05


def test_edges(spark):
    pages, labels, _ = table(spark, 300)
    rows = [(None, None, "a"), (1, "", "b"), (2, "no scheme", None), (2, "no scheme", None), (3, "http://x" + "y" * 50_000 + ".com/" + "z" * 50_000, None), (4, "http:///", None)]
    mine = spark.createDataFrame(rows, "page_id long, url string, suffix string")
    got = url_filter.filter_urls(mine.unionByName(pages, allowMissingColumns=True), labels).toPandas()
    assert len(got) == 306
    none = got[got.url.isna() | (got.url == "")]
    assert none.bad_score.isna().all() and not none.keep.any()
    out = url_filter.filter_urls(mine, labels.limit(0)).toPandas()
    assert out.bad_score.isna().all() and out.keep.sum() == 4
    assert url_filter.filter_urls(mine.limit(0), labels).count() == 0


def test_first_split_is_the_best_of_all():
    """A tree of depth 1 against every split of every feature."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (60, 3)).astype(float)
    y = (x[:, 1] > 6).astype(float)
    y[:6] = 1 - y[:6]
    (feature, cut, value), = Trees.fit(x, y, rounds=1, depth=1).trees
    p = y.mean()
    slope, bend = p - y, np.full(len(y), p * (1 - p))

    def gain(j, c):
        left = x[:, j] <= c
        g = [slope[left].sum(), slope[~left].sum()]
        h = [bend[left].sum(), bend[~left].sum()]
        return sum(a * a / (b + 1) for a, b in zip(g, h)) if min(h) >= 2 else -1

    best = max((gain(j, c), j, c) for j in range(3) for c in np.unique(x[:, j]))
    assert (feature[0], gain(feature[0], cut[0])) == (best[1], pytest.approx(best[0]))
    left = x[:, feature[0]] <= cut[0]
    for node, own in ((1, left), (2, ~left)):
        assert value[node] == pytest.approx(-0.1 * slope[own].sum() / (bend[own].sum() + 1))


def test_hot_suffix_and_plain_counts(spark):
    rows = [(i, f"http://h{i % 7}.hot.com/en/{i}") for i in range(300)] + [(i, f"http://x.rare{i}.org/") for i in range(300, 320)] + [(400, None), (401, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = {r.page_id: r.x for r in url_filter._featured(pages, labels, "page_id", "url").collect()}
    assert len(got) == len(rows)
    at = [url_filter.FEATURES.index(f) for f in ("suffix_urls", "suffix_hosts")]
    assert got[5][at[0]] == pytest.approx(math.log1p(300)) and got[5][at[1]] == pytest.approx(math.log1p(7))
    assert got[310][at[0]] == pytest.approx(math.log1p(1)) and got[400][at[0]] == 0
