"""Attention by blocks against sums over all pairs."""

import math

from sievework.functions import numerics


def test_blocks_against_all_pairs(spark):
    rows = [(i, i % 3, [math.sin(i * j) for j in range(1, 6)]) for i in range(40)] + [(5, 2, [9.0, 0.0, 0.0, 0.0, 1.0]), (70, 1, None), (71, 1, [1.0, 2.0]), (72, None, [1.0] * 5), (None, 0, [0.5] * 5), (73, 0, [700.0] * 5)]
    table = spark.createDataFrame(rows, "i long, part int, vector array<double>").repartition(3)
    got = numerics.attention(table.withColumnRenamed("i", "q"), table.withColumnRenamed("i", "k"), 0.5, block=4)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    score = [(q, k, sum(x * y for x, y in zip(a, b)) * 0.5 if a and b and len(a) == len(b) else None) for q, p, a in rows for k, r, b in rows if p is not None and p == r]
    most = {q: max(s for p, _, s in score if p == q and s is not None) for q in {p for p, _, s in score if s is not None}}
    total = {q: sum(math.exp(s - most[q]) for p, _, s in score if p == q and s is not None) for q in most}
    want = [(q, k, None if s is None else round(math.exp(s - most[q]) / total[q], 9)) for q, k, s in score]
    assert sorted(((r.q, r.k, None if r.weight is None else round(r.weight, 9)) for r in got.collect()), key=repr) == sorted(want, key=repr)
