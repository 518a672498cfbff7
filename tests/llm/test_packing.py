import random

import numpy as np
import pytest

from sievework.llm import packing


def naive(lengths, capacity):
    room, out = [], []
    for n in lengths:
        for b, r in enumerate(room):
            if r >= n:
                break
        else:
            b = len(room)
            room.append(capacity)
        out.append((b, capacity - room[b]))
        room[b] -= n
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tournament_is_first_fit(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, rng.choice([3, 40, 100])) for _ in range(rng.randint(1, 300))), reverse=True)
    bins, offset = packing.first_fit_decreasing(np.array(lengths), 100)
    assert list(zip(bins.tolist(), offset.tolist())) == naive(lengths, 100)


def test_documents_match_a_plain_packing(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 1, 5, 5, 30, 99, 100, 257])) for i in range(150)] + [(None, "né"), (None, None), (3, "yy"), (3, "yy"), (200, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bin_id int")
    got = packing.pack_documents(docs, capacity=100, group_size=60).toPandas()
    assert got.group_id.nunique() == 3
    want_parts = sum(1 if t is None else max(1, -(-(len(t.encode()) + 1) // 100)) for _, t in rows)
    assert len(got) == want_parts
    assert got.length.sum() == sum(len(t.encode()) + 1 for _, t in rows if t is not None)
    empty = got[got.bin_id.isna()]
    assert len(empty) == 2 and (empty.length == 0).all()
    for _, group in got[got.bin_id.notna()].groupby("group_id"):
        group = group.assign(none=group.doc_id.isna(), key=group.doc_id.fillna(0)).reset_index(drop=True)
        total = group.groupby(["doc_id", "part"], dropna=False).length.sum()
        ordered = group.sort_values("length", ascending=False, kind="stable")
        assert sorted(naive(ordered.length.tolist(), 100)) == sorted(zip(group.bin_id.astype(int), group.bin_offset.astype(int)))
        assert (group.groupby("bin_id").length.sum() <= 100).all() and len(total)


def test_ties_are_taken_by_id(spark):
    docs = spark.createDataFrame([(i, "x" * 9) for i in (5, 3, 9, 1)], "doc_id long, text string")
    got = packing.pack_documents(docs, capacity=20).orderBy("doc_id").toPandas()
    assert got.bin_id.tolist() == [0, 0, 1, 1] and got.bin_offset.tolist() == [0, 10, 0, 10]


def test_empty_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, capacity=0)


def test_great_ids_beside_null_and_a_text_of_many_bins(spark):
    """Which document got which place, against the plain packing of the group."""
    rows = [(9007199254740993, "x" * 50), (9007199254740995, "x" * 50), (None, "y" * 50), (-(2**63), "z" * 12_345), (2**63 - 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, capacity=100).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == sorted(k for k, _ in rows if k is not None)
    pieces = [(min(100, len(t) + 1 - 100 * p), k is None, k or 0, p) for k, t in rows for p in range(-(-(len(t) + 1) // 100))]
    pieces.sort(key=lambda x: (-x[0], *x[1:]))
    want = {(None if none else k, p): place for (_, none, k, p), place in zip(pieces, naive([x[0] for x in pieces], 100))}
    assert {(r.doc_id, r.part): (r.bin_id, r.bin_offset) for r in got} == want
