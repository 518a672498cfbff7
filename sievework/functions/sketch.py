"""Similarity sketches of 64 bits: token trigrams vote on each bit, repeats count, and a tie sets the bit.

Two hashes of a trigram are offered, both in Arrow batches: BLAKE2b with 8 bytes, and the first 8 bytes of SHA-256, which
SQL engines have too. Signatures are signed longs holding the unsigned value's bits; a text
without tokens has all bits set.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import text as t
from sievework.functions.arrow import joined, slices

BITS = 64
_TOKEN = re.compile(t.WORD)


def _vote(digests: list[bytes]) -> int:
    """The signed signature of trigram digests of 8 bytes."""
    if not digests:
        return -1
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(axis=0, dtype=np.int64) >= len(digests)
    return int(np.frombuffer(np.packbits(votes).tobytes(), ">i8")[0])


def _grams(tokens: list[str]) -> list[str]:
    return ["\x1f".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] if len(tokens) >= 3 else tokens


def simhash_of(text: str) -> int:
    """The signed BLAKE2b signature of one text."""
    return _vote([hashlib.blake2b(g.encode(), digest_size=8).digest() for g in _grams(_TOKEN.findall(" ".join(text.casefold().split())))])


# The UDFs take a batch of Spark by pieces, so Python never holds the words of all its texts.


@F.arrow_udf(T.LongType())
def simhash_blake2b(text: pa.Array) -> pa.Array:
    return joined([pa.array([None if x is None else simhash_of(x) for x in part.to_pylist()], pa.int64()) for part in slices(text)], pa.int64())


def _signature_of(words: list[str]) -> int:
    return _vote([hashlib.sha256(g.encode()).digest()[:8] for g in _grams(words)])


@F.arrow_udf(T.LongType())
def _simhash_words(words: pa.Array) -> pa.Array:
    return joined([pa.array([None if x is None else _signature_of(x) for x in part.to_pylist()], pa.int64()) for part in slices(words)], pa.int64())


def simhash_words(text: str) -> Column:
    """The signature by SHA-256, of the words that the JVM finds."""
    return _simhash_words(t.words(F.col(text)))


def simhash_sha(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signature) by SHA-256; nothing is shuffled."""
    return rows.select(key, simhash_words(text).alias("signature"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return F.bit_count(a.bitwiseXOR(b))


def bands(signature: Column, count: int = 4) -> Column:
    """The signature cut into `count` runs of bits, the lowest first."""
    edges = [round(BITS * i / count) for i in range(count + 1)]
    cut = [F.shiftrightunsigned(signature, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("long") for a, b in zip(edges[:-1], edges[1:])]
    return F.array(*cut)


def hex16(signature: Column) -> Column:
    return F.lower(F.lpad(F.hex(signature), 16, "0"))
