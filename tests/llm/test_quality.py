import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sievework.llm import labelled, quality_classifier, quality_rules


def text(rng, good, n=None):
    words = ["".join(rng.choice(["an", "re", "ti", "on", "es", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(n or rng.randint(30, 200))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    kind = rng.randrange(3)
    return " ".join(f"{w.upper()}!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(f"{w}%%%" for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 3 > 0)) for i in range(900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    return documents.cache(), labels.cache()


@pytest.mark.parametrize("module", [quality_classifier, quality_rules])
def test_held_out_accuracy_and_calibration(tables, module):
    got = module.classify_documents(*tables).toPandas()
    assert len(got) == 900
    held = got[got.doc_id % 2 == 1]  # never labelled
    good = held.doc_id % 3 > 0
    assert (held.keep == good).mean() > 0.97 and (held.keep[good]).mean() > 0.99
    assert held.score[good].mean() > 0.85 and held.score[~good].mean() < 0.2


@pytest.mark.parametrize("module", [quality_classifier, quality_rules])
def test_edges(spark, tables, module):
    documents, labels = tables
    rng = random.Random(2)
    long = text(rng, True, 60_000)
    rows = [(1, None, "a", None, 1.0), (2, "", None, True, 1.0), (3, " \n\t", None, True, 1.0), (None, text(rng, True), "b", True, None), (4, long, "c", None, None), (4, long, "c", None, None), (5, text(rng, False), "d", False, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, keep boolean, score double")
    kept = module.keep_good(docs, documents, labels)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[3:6], key=str)
    assert module.keep_good(docs.limit(0), documents, labels).count() == 0
    nulls = labels.selectExpr("cast(null as long) doc_id", "cast(null as int) quality", "toxic")
    for none in (labels.limit(0), labels.where("quality = 1"), nulls):
        out = module.classify_documents(docs.select("doc_id", "text"), none).toPandas()
        assert out.score.isna().all() and out.keep.sum() == 4


def brute_grams(raw):
    """The n-grams of a text one by one."""
    low, words, word = raw.lower(), [], b""
    for b in [bytes([x]) for x in raw] + [b" "]:
        inside = b.isalnum() or b == b"_" or b[0] >= 128
        if inside:
            word += b.lower() if b[0] < 128 else b
        elif word:
            words.append(word)
            word = b""
    pairs = ["=" if a == b else (a, b) for a, b in zip(words, words[1:])]
    return [words, pairs, [raw[i : i + 3] for i in range(len(raw) - 2)], [raw[i : i + 5] for i in range(len(raw) - 4)]], low


def test_grams_match_brute_force():
    texts = ["", "a", "One one ONE two", "é é b_c 12\nab", "abcdefg", "x y x y x y"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    seen = {}
    for kind, (place, first) in enumerate(quality_rules.grams(data, offs)):
        for i, r in enumerate(raw):
            want = brute_grams(r)[0][kind]
            got = place[first[i] : first[i + 1]].tolist()
            assert len(got) == len(want)
            for g, w in zip(got, want):
                assert seen.setdefault((kind, w), g) == g
    assert len(set(seen.values())) == len(seen)  # in this small set no two collide


def test_scores_are_the_sparse_product():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=quality_rules.SPACE).astype(np.float32)
    texts = ["some Words here, and more words here", "", "z " * 400]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 1, 1]), pa.array([0, 0, 0]), pa.array(texts)], names=["id", "good", "fold", "text"])
    (out,) = quality_rules._vectors(iter([batch]))
    sparse = [float(weights[np.frombuffer(p, np.int32)] @ np.frombuffer(v, np.float32)) for p, v in zip(out.column("places").to_pylist(), out.column("values").to_pylist())]
    from sievework.llm import textvec

    np.testing.assert_allclose(quality_rules.raw_scores(*textvec.utf8(pa.array(texts)), weights), sparse, rtol=1e-4, atol=1e-6)


def test_compressed_sizes_cover_the_whole_text():
    rng = random.Random(3)
    good = zstandard.train_dictionary(4096, [text(rng, True).encode() for _ in range(300)]).as_bytes()
    bad = zstandard.train_dictionary(4096, [text(rng, False).encode() for _ in range(300)]).as_bytes()
    head = text(rng, True, 100).encode()
    tail = b" ".join(text(rng, False).encode() for _ in range(20))
    x = quality_classifier.features([head, head + b" " + tail], good, bad)
    assert x[0, 0] < 0 < x[1, 0]


def test_logistic_fit_separates_and_stays_finite():
    x = np.linspace(-3, 3, 200)[:, None]
    w = labelled.fit_logistic(x, x[:, 0] > 0)
    assert np.isfinite(w).all() and w[0] > 1 and abs(w[1]) < 0.2
    assert labelled.fit_logistic(x, np.ones(200, bool)) is None


def test_sample_is_bounded_and_resolves_conflicts(spark, tables):
    documents, _ = tables
    labels = spark.createDataFrame([(i, q, 0) for i in range(300) for q in ((0, 1) if i == 7 else (1,))] + [(1000, 0, 0), (8, None, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = labelled.sample(documents, labels, 50, 1).toPandas()
    assert (got.good == 1).sum() == 50 and got[got.good == 0].id.tolist() == [7]


def test_pieces_of_the_dictionaries_are_bounded_by_a_parameter(tables):
    few, many = (quality_classifier.train(*tables, pieces_per_class=n) for n in (1, 300))
    for c in (0, 1):
        assert len(few[c]) <= quality_classifier.PIECE < len(many[c])


def test_classifier_is_its_parts_put_together(spark):
    """op5 against zstandard and a logistic function, text by text."""
    import math
    import zstandard

    rng = random.Random(8)
    good = [" ".join(rng.choice("the river ran along a quiet old field where people walked".split()) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice("CLICK buy now!!! $$$ free win cash prize xxx".split()) for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(good + bad)) + [(500, None), (501, ""), (502, " \n\t "), (503, "é" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = {r.row.doc_id: r for r in quality_classifier.classify(docs, model).collect()}

    def size(raw, words):
        kept = zstandard.ZstdCompressionDict(words)
        kept.precompute_compress(level=1)
        one = zstandard.ZstdCompressor(level=1, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(one.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))

    for key, text in rows:
        r = got[key]
        if text is None or not text.strip():
            assert r.score is None and not r.keep
            continue
        raw = text.encode()
        x, y = size(raw, model[0]), size(raw, model[1])
        d, ratio = (x - y) / (max(x, y) + 192), math.log((x + 192) / (len(raw) + 192))
        p = 1 / (1 + math.exp(-(model[2][0] * d + model[2][1] * ratio + model[2][2])))
        assert (r.size_difference, r.score, r.keep) == (pytest.approx(d), pytest.approx(p), p >= quality_classifier.THRESHOLD)
    assert all(got[i].keep == (i < 60) for i in range(120))


def test_rules_are_their_parts_put_together(spark):
    """op4: every document's score from its own n-grams, counted one by one."""
    import math

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("the river ran along a quiet field" if i % 2 else "CLICK buy now free win cash").split()) for _ in range(40))) for i in range(160)] + [(500, None), (501, " "), (502, "word " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    weights, (slope, offset) = quality_rules.train(docs, labels)
    got = {r.row.doc_id: r for r in quality_rules.apply_rules(docs, (weights, [slope, offset])).collect()}
    for key, text in rows:
        if text is None or not text.strip():
            assert got[key].score is None and not got[key].keep
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        total = sum(sum(float(weights[p]) for p in place.tolist()) / (quality_rules.NEUTRAL + len(place)) for place, _ in quality_rules.grams(data, np.array([0, len(data)])))
        p = 1 / (1 + math.exp(-(slope * total + offset)))
        assert got[key].score == pytest.approx(p, rel=1e-6) and got[key].keep == (p >= quality_rules.THRESHOLD)
    assert all(got[i].keep == bool(i % 2) for i in range(160))


def test_long_texts_take_part_whole():
    rng = random.Random(5)
    raw = "".join(rng.choice(["word", "é", "X", " ", "\n", "a ", "- "]) for _ in range(3000)).encode()
    data = np.frombuffer(raw, np.uint8)
    want = [np.sort(place) for place, _ in quality_rules.grams(data, np.array([0, len(data)]))]
    for limit in (1, 7, 1000, len(raw)):
        got = {kind: [] for kind in (1, 2, 3, 4)}
        for kind, place in quality_rules.long_grams(data, limit):
            got[kind].append(place)
        for kind in got:
            np.testing.assert_array_equal(np.sort(np.concatenate(got[kind])), want[kind - 1])


def test_vectors_and_scores_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(6)
    raw = rng.choice(np.frombuffer(b"abcdefghijkl  .", np.uint8), 5000)
    offs, weights = np.array([0, 40, 5000]), rng.normal(size=quality_rules.SPACE).astype(np.float32)
    whole, vector = quality_rules.raw_scores(raw, offs, weights), quality_rules._vector(raw)
    monkeypatch.setattr(quality_rules, "LONG", 1000)
    np.testing.assert_allclose(quality_rules.raw_scores(raw, offs, weights), whole, rtol=1e-6)
    parts = quality_rules._vector(raw)
    np.testing.assert_allclose(np.bincount(*parts, quality_rules.SPACE), np.bincount(*vector, quality_rules.SPACE), rtol=1e-6)


def test_fit_of_long_varied_texts_does_not_pass_through_the_driver(spark):
    """Vectors beyond the limit of the driver's results, as full rows and as places, give the model of fit in memory."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz   " if i % 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ!!  ", k=30_000 if i % 4 else 3_000))) for i in range(40)] + [(40, ""), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(42)], "doc_id long, quality int, toxic int")
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        held, read = (quality_rules.train(docs, labels, in_memory=n) for n in (1 << 40, 0))
    finally:
        conf.set("spark.driver.maxResultSize", before)
    np.testing.assert_allclose(read[0], held[0], atol=1e-3)
    np.testing.assert_allclose(read[1], held[1], rtol=1e-3)
    got = {r.row.doc_id: r for r in quality_rules.apply_rules(docs, read).collect()}
    assert all(got[i].keep == bool(i % 2) for i in range(40))
