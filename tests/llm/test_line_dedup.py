import random

import pytest

from sievework.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(rows, min_chars):
    """Every pair of line occurrences, each line keeping its earliest neighbour's place."""
    order = lambda p: (p[0] is None, p[0] or 0, p[1])
    lines = [(key, i, line) for key, text in rows if text is not None for i, line in enumerate(text.split("\n"))]
    out = []
    seen = set()
    for key, i, line in lines:
        first = (key, i)
        if len(line) >= min_chars:
            near = [(k, j) for k, j, other in lines if len(other) >= min_chars and abs(len(line) - len(other)) < 2 and distance(line, other) <= 1]
            first = min(near, key=order)
        keep = first == (key, i)
        if len(line) >= min_chars and keep:
            keep = (key, i, line) not in seen
            seen.add((key, i, line))
        out.append((key, i, *first, keep))
    return sorted(out, key=str)


def edited(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "x" + line[i + 1 :], line[:i] + "é" + line[i:], line])


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["", "short", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "a sentence of some length", "ünïcode 🙂 line", "b" * 12]
    rows = []
    for i in range(25):
        lines = [rng.choice(base) for _ in range(rng.randrange(5))]
        lines = [edited(rng, x) if x and rng.random() < 0.6 else x for x in lines]
        rows.append((rng.randrange(1000) * 100 + i, "\n".join(lines)))
    rows += [(None, "a sentence of some length\nnew with no number"), (2, None), (10**6, "rows that repeat\nrows that repeat"), (10**6, "rows that repeat\nrows that repeat")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, line_no int, h string").repartition(3)
    got = line_dedup.find_lines(docs, min_chars=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 8)


def test_long_lines_and_empty_table(spark):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long[:70_000] + "#" + long[70_001:]), (3, long[1:]), (4, long[2:])], "doc_id long, text string")
    got = {r.doc_id: (r.first_doc_id, r.keep) for r in line_dedup.find_lines(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (3, False)}
    assert line_dedup.find_lines(docs.limit(0)).count() == 0


def within(rows, min_chars, edits):
    """brute() for any bound; every place is of one row."""
    lines = sorted((key, i, line) for key, text in rows for i, line in enumerate(text.split("\n")))
    out = []
    for n, (key, i, line) in enumerate(lines):
        near = [(k, j) for k, j, other in lines[:n] if min(len(line), len(other)) >= min_chars and abs(len(line) - len(other)) <= edits and distance(line, other) <= edits]
        out.append((key, i, *(near[0] if near else (key, i)), not near))
    return out


@pytest.mark.parametrize("edits", [2, 3])
def test_wider_bound_matches_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["", "short", "aaaaaaaaaa", "abababababab", "a sentence of some length", "walked in the old town", "walked to the old town", "ünïcode 🙂 line"]
    rows = []
    for i in range(30):
        lines = [rng.choice(base) for _ in range(rng.randrange(1, 6))]
        for _ in range(edits + 1):
            lines = [edited(rng, x) if x and rng.random() < 0.7 else x for x in lines]
        rows.append((i * 7, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.find_lines(docs, min_chars=8, edits=edits)
    assert sorted(map(tuple, got.collect())) == within(rows, 8, edits)
    assert line_dedup.find_lines(docs.limit(0), edits=edits).count() == 0


def test_segments_lose_no_pair():
    import numpy as np

    rng = random.Random(5)
    for _ in range(2000):
        edits = rng.choice([2, 3, 4])
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 16)))
        b = a
        for _ in range(edits):
            b = edited(rng, b) if b else b
        a, b = sorted((a, b), key=len)
        assert distance(a, b) <= edits
        keys = [{(int(t), x[p : p + m]) for own, _, tag, begin, size in line_dedup._segments(np.array([len(x)]), edits) if own or x is b for t, p, m in zip(tag, begin, size)} for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("edits", [1, 2])
def test_short_lines_take_part_in_the_exact_collapse(spark, edits):
    docs = spark.createDataFrame([(1, "Les.\n\nLes!\na sentence of some length"), (2, "Les.\n\nb sentence of some length\nLes."), (3, "Les!\nA\nA")], "doc_id long, text string")
    got = {tuple(r[:2]): tuple(r[2:]) for r in line_dedup.find_lines(docs, edits=edits, exact_chars=1).collect()}
    dropped = {(2, 0): (1, 0, False), (2, 3): (1, 0, False), (2, 2): (1, 3, False), (3, 0): (1, 2, False), (3, 2): (3, 1, False)}
    assert len(got) == 11 and got == {p: dropped.get(p, (*p, True)) for p in got}


def test_within_is_the_distance():
    rng = random.Random(11)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(24)))
        b = a
        for _ in range(rng.randrange(5)):
            b = edited(rng, b) if b else b
        if rng.random() < 0.2:
            b = "".join(rng.choice("abé") for _ in range(rng.randrange(24)))
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits), (a, b, edits)
