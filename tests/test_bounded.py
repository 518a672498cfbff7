"""What tasks hold in Python doesn't follow the size of Spark's batches."""

import hashlib

import pyarrow as pa

from sievework.functions import arrow, sketch
from sievework.operators import tokens


def test_ids_are_returned_by_pieces():
    texts = ["<|eos|>" + "é" * 500, None, "", "x" * 3_000_000] * 6
    pieces = list(tokens.encoded(iter([pa.array(texts)]), eos=True))
    assert len(pieces) > 6 and max(p.nbytes for p in pieces) < 4 * (3_000_000 + arrow.BYTES) + 1000
    assert [i for p in pieces[:2] for i in p.to_pylist()][:3] == [tokens.encode_bytes(texts[0], eos=True).tolist(), None, tokens.encode_bytes("", eos=True).tolist()]
    assert sum(len(p) for p in pieces) == len(texts)


def test_words_are_taken_by_pieces(spark):
    lists = [["a", "b"], None, []] + [["w"] * 50_000] * 9
    assert [len(x) for x in arrow.slices(pa.array(lists))] == [5, 2, 2, 2, 1]
    rows = [(i, f"Straße {i} " + "wort " * (i % 7)) for i in range(500)] + [(500, None), (501, "")]
    table = spark.createDataFrame(rows, "i long, text string").coalesce(1)
    got = {r.i: (r.a, r.b) for r in table.select("i", sketch.simhash_blake2b("text").alias("a"), sketch.simhash_words("text").alias("b")).collect()}
    grams = lambda x: sketch._grams(sketch._TOKEN.findall(x))
    vote = lambda x: sketch._vote([hashlib.sha256(g.encode()).digest()[:8] for g in grams(x.lower().replace("ß", "ss"))])
    assert got == {i: (None, None) if x is None else (sketch.simhash_of(x), vote(x)) for i, x in rows}
