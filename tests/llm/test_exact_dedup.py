import random

import pytest

from sievework.llm import exact_dedup
from sievework.llm.exact_dedup import ExtendibleIndex


def test_index_splits_doubles_and_chains(tmp_path):
    rng = random.Random(3)
    index, plain = ExtendibleIndex(bucket_size=4), {}
    for i in range(3000):
        h = rng.choice([rng.getrandbits(64), rng.getrandbits(3), rng.getrandbits(8) << 56])
        plain.setdefault(h, []).append(index.add(h, i if i % 7 else None))
    assert index.depth > 4 and len(index.directory) == 1 << index.depth
    index.save(str(tmp_path), 5)
    for opened in (index, ExtendibleIndex.load(str(tmp_path), 5)):
        assert all(sorted(opened.chain(h)) == entries for h, entries in plain.items())
        assert list(opened.chain(12345678901234567)) == []
        assert all(len(b) <= 4 for b in opened.buckets)
        assert opened.keys[7] is None and opened.keys[8] == 8


def brute(rows):
    best = {}
    for key, text in rows:
        if text is not None:
            order = (key is None, key)
            if text not in best or order < best[text]:
                best[text] = order
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0)):
        if text is None:
            out.append((key, key, False))
        else:
            out.append((key, best[text][1], text in seen))
            seen.add(text)
    return sorted(out, key=str)


@pytest.mark.parametrize("owners", [3, 10_000])
def test_matches_brute_force(spark, owners):
    rng = random.Random(owners)
    texts = ["", " ", "a", "A", "b" * 200_000, None] + [f"text {i}" for i in range(15)]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(None, "a"), (None, "only here"), (None, "only here"), (5, "text 1"), (5, "text 1"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.find_copies(docs, rows_per_owner=owners, bucket_size=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_hash_for_all_still_compares_bytes(spark, monkeypatch):
    """All texts in one chain: the bytes alone decide."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 5), pa.array([42] * 5), pa.array([1, 2, 3, 4, 5]), pa.array(["x", "y", "x", "z", "y"])], names=["__owner", "__hash", "__id", "__text"]
    )
    monkeypatch.setattr(ExtendibleIndex, "save", lambda *a: None)
    (_, found, entries), = exact_dedup._decide(iter([batch]), "", 2)
    assert entries == [0, 1, 0, 2, 1] and found == [(1, False), (2, False), (1, True), (4, False), (2, True)]


def test_drop_keeps_rows_and_clashing_columns(spark):
    rows = [(2, "x", "b", None, 1), (1, "x", "a", 4, 2), (3, None, "c", None, 3), (4, None, "c", None, 3), (1, "x", "a", 4, 2), (None, "", None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __owner string, __hash int, keeper_id int")
    got = sorted(map(tuple, exact_dedup.drop_copies(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[5]], key=str)
    assert exact_dedup.drop_copies(docs).schema == docs.schema
    empty = docs.limit(0)
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.find_copies(empty).count() == 0


@pytest.mark.parametrize("owners", [3, 10_000])
def test_a_hot_text_keeps_one_row(spark, owners):
    """Two thirds of the rows are two texts, some without an id; spread over tasks or not, the same rows stay."""
    rng = random.Random(owners)
    rows = [(rng.choice([None, rng.randrange(500)]), rng.choice(["hot", "hot too", f"own {i}"]), i) for i in range(200)] + [(None, None, 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int").repartition(6)
    kept = exact_dedup.drop_copies(docs, rows_per_owner=owners)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((k, t) for (k, t), mark in zip([r[:2] for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))], _first(rows)) if mark), key=str)
    assert sorted(map(tuple, exact_dedup.find_copies(docs, rows_per_owner=owners).collect()), key=str) == brute([r[:2] for r in rows])


def _first(rows):
    """Of the rows in the order of ids, whether each is the first of its text."""
    seen, out = set(), []
    for _, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append(text is None or text not in seen)
        seen.add(text)
    return out


def test_owners_are_bounded_by_bytes_too(spark):
    """Few long texts, one of them hot by its bytes alone, go to several owners; the same rows stay."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["hot " * 50, f"own {i} " * 30, "é" * 40, None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, found = exact_dedup.drop_copies(docs, bytes_per_owner=1000), exact_dedup.find_copies(docs, bytes_per_owner=1000)
    size = sum(len(t.encode()) for _, t in rows if t)
    assert kept.rdd.getNumPartitions() == -(-size // 1000) and exact_dedup._parted(exact_dedup._hashed(docs, "doc_id", "text", False), 20_000, 1000)[1] is not None
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r, first in zip(rows, _first([(*r, 0) for r in rows])) if first), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
