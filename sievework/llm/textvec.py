"""Vectorised kernels over batches of UTF-8 text: words and their hashes without a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15

#: Letters, digits, underscore and every byte of a character beyond ASCII.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)], dtype=bool)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offset at which each text begins (one more at the end). A null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes, never across texts; and the first run of each text."""
    inside = member[data]
    starts_, ends_ = inside.copy(), inside.copy()
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[first] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[last] = False
    starts = np.flatnonzero(starts_ & ~before)
    ends = np.flatnonzero(ends_ & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte range as 8-byte numbers, the last filled with zeros: the numbers, each one's place in its range, and the ranges' first numbers."""
    size = ends - starts
    n = (size + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    code = wide[np.repeat(starts, n) + 8 * place]
    last = begin[1:][n > 0] - 1
    code[last] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) * (-size[n > 0]).astype(np.uint64)) & np.uint64(63))
    return code, place, begin


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: its 8-byte numbers are mixed with a key of their place, added up, and mixed with the length.

    No sum of powers, which texts such as Thue-Morse sequences defeat modulo 2**64. Another seed gives another hash.
    """
    code, place, begin = chunks(data, starts, ends)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, int(place.max(initial=0)) + 2, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code ^ key[place]), dtype=np.uint64)])
        return mix(total[begin[1:]] - total[begin[:-1]] + (ends - starts).astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each byte range has the bytes of its counterpart."""
    same = ends - starts == other_ends - other_starts
    at = np.flatnonzero(same)
    mine, _, begin = chunks(data, starts[at], ends[at])
    theirs, _, _ = chunks(other, other_starts[at], other_ends[at])
    wrong = np.concatenate([[0], np.cumsum(mine != theirs)])[begin]
    same[at] = wrong[1:] == wrong[:-1]
    return same


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII letters in lower case), and the index of the first word of each text."""
    starts, ends, first = spans(data, offs)
    return span_hashes(LOWER[data], starts, ends), first


def shingle_hashes(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text; a text of fewer words, but not none, has its whole as one shingle.

    Gives them in the order of the texts, and the index of each text's first shingle.
    """
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(have)])
    doc = np.repeat(np.arange(len(count)), have)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    out = np.zeros(len(at), np.uint64)
    stop = first[doc + 1] if len(doc) else at
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(n):
            part = np.where(at + k < stop, padded[at + k], np.uint64(0))
            out = out * np.uint64(_BASE) + part
    return mix(out), begin
