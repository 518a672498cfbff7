"""The pipeline against a plain chain of its stages, and this subpackage's queries against their SQL."""

import glob
import os
import random

import duckdb
import pytest
from test_near_dedup import plain_groups
from test_packing import naive
from test_quality import text

import corpus_pipeline
from sievework.llm import labelled, quality_classifier, quality_rules, queries

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_run_matches_a_plain_chain(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 3 > 0, 120)) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 4)]  # copies
    rows += [(2000 + i, rows[i][1] + " one more") for i in range(1, 60, 4)]  # near copies
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tables = [spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")]

    good, bad, w = quality_classifier.train(*tables)
    kept = [(i, t) for i, t in rows if labelled.sigmoid(quality_classifier.features([t.encode()], good, bad) @ w[:-1] + w[-1])[0] >= quality_classifier.THRESHOLD]
    assert len(kept) < len(rows)
    pass_rules = {r.doc_id for r in quality_rules.classify_documents(*tables).where("keep").collect()}
    kept = sorted((i, t) for i, t in kept if i in pass_rules)
    first = {}
    for i, t in kept:
        first.setdefault(t, i)
    assert len(first) < len(kept)
    kept = [(i, t) for t, i in first.items()]
    roots, _ = plain_groups([t for _, t in kept])
    assert len(set(roots)) < len(kept)
    kept = {kept[k][0]: kept[k][1] for k in set(roots)}

    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    lengths = got.groupby("doc_id").length.sum().to_dict()
    assert lengths == {i: len(t.encode()) + 1 for i, t in kept.items()}
    want = naive(sorted(got.length.tolist(), reverse=True), 4096)
    assert sorted(want) == sorted(zip(got.bin_id.astype(int), got.bin_offset.astype(int)))
