"""Line dedup within an edit bound: keys that lines within the bound share are joined, distance verified, earliest kept.

A line takes part if it has `min_chars` characters or more. With `exact_chars` below that, lines of so many characters or more
take part too, but only equal ones are within their bound. An occurrence is dropped if an earlier one in the corpus, in the order of
(doc_id, line), has a line within the edit distance bound, `edits`: equal lines are at distance 0, and the
earlier one counts whether or not it is dropped itself. So the first of each distinct line stays unless a line within the bound begins earlier.

Steps for a bound of 1, a deletion-neighbourhood join. One pass over the texts gives each line's place, its hash of 128 bits, which stands for it from here on, and the keys of its
halves. Equal lines are collapsed to their first place. A necessary condition thins them: two lines one edit
apart agree in their first or in their last half (the halves of the longer one), so a line whose half no other distinct line of a
fitting length has can't have a partner. Those left, by the lengths of the partners they may have, emit every variant with one character
deleted as a hashed key: equal lengths meet at equal (variant, place), which is one substitution; a line one longer meets
the shorter at the shorter line itself, which is one deletion. Such groups are stars around the variant, so the least first place of the group is
each member's candidate and no group is multiplied out. Then the texts of the line and its candidate are compared, and the
distance verified. Texts are joined with the lines left by the condition by shuffle; before it, a filter of `filter_bits` bits, of a size that doesn't grow, drops
most lines that aren't among them (fewer, the more lines are left; the result is the same). Keys that many lines share are never gathered: the least place of a key is aggregated, then joined, which
adaptive execution splits where a key is hot.

Steps for a bound of 2 or more. The shorter of two lines is cut into edits + 1 segments, of which one at least stands unchanged in the longer,
moved by few characters (`_segments`). Every line's substrings that may be such a segment of a line up to `edits` shorter
are keys; the line's own segments are among them. Lines no key of which another distinct line shares are left out. Those left are
joined by key, pairs whose parity sketches differ by more than the edits can explain are dropped, and the distance of the rest is verified.
Lines of few characters have short segments, which many lines share: these groups do multiply out, before the sketches.

Defined results: a null text has no lines. An empty text has one empty line. Empty lines, and those of fewer characters than both, are kept always (at `exact_chars` 0 empty lines are equal lines too). Lines of any length are compared whole. Ids are whole numbers. A null id counts as
the greatest. Rows that repeat are copies: the second row's lines are dropped. Lines end with \\n only, and are compared
as they are. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import textvec
from sievework.llm.shared import written

#: Seed of the second of the two hashes that stand for a line.
SECOND = 0xD6E8FEB86659FD93
_PRIME = np.uint64((1 << 31) - 1)
#: Bases, and their inverses modulo the prime, of the two sums that hash a line less a character.
_BASES = tuple((b, pow(b, -1, (1 << 31) - 1)) for b in (1_103_515_245, 1_664_525_001))
OCCURRENCE = "doc_id long, line_no int, h long, g long, k0 long, k1 long, k2 long, k3 long"


class _Lines:
    """The lines of a run of texts: text, number and byte range of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, null: np.ndarray) -> None:
        self.data = data
        breaks = np.flatnonzero(data == 10)
        doc = np.concatenate([np.arange(len(null)), np.searchsorted(offs, breaks, "right") - 1])
        start = np.concatenate([offs[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        last = np.append(doc[1:] != doc[:-1], True)
        end = np.where(last, offs[doc + 1], np.append(start[1:], 0) - 1)
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        stay = ~null[doc]
        self.doc, self.start, self.end, self.number = doc[stay], start[stay], end[stay], number[stay]
        lead = (data & 0xC0) != 0x80
        self.signs = np.concatenate([[0], np.cumsum(lead)])
        self.at = np.append(np.flatnonzero(lead), len(data))
        self.size = self.signs[self.end] - self.signs[self.start]  # in characters

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return textvec.span_hashes(self.data, start, end, seed)

    def second(self) -> np.ndarray:
        return self.hash(self.start, self.end, SECOND)

    def halves(self) -> list[np.ndarray]:
        """Keys of the first and last half for a longer line of its own length, then for one of a character more."""
        keys, base = [], self.signs[self.start]
        with np.errstate(over="ignore"):
            for more in (0, 1):
                m = self.size + more
                half, rest = m // 2, m - m // 2 - 1
                cut = np.where(half < self.size, self.at[base + np.minimum(half, self.size)], self.end)
                tail = np.where(rest > 0, self.at[base + self.size - np.maximum(rest, 0)], self.end)
                tag = m.astype(np.uint64) * np.uint64(2)
                keys.append(textvec.mix(self.hash(self.start, np.minimum(cut, self.end)) * np.uint64(7) + tag))
                keys.append(textvec.mix(self.hash(tail, self.end) * np.uint64(7) + tag + np.uint64(1)))
        return keys


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Lines]]:
    for batch in batches:
        data, offs = textvec.utf8(batch.column(1))
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for i, j in textvec.pieces(offs):
            yield batch.column(0).slice(i, j - i), _Lines(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j])


def _occurrences(docs: DataFrame, min_chars: int, halves: bool, exact_chars: int) -> DataFrame:
    """Every line's place, its hash (null where it takes no part) and, if asked for, the keys of its halves (null where only equal lines count)."""
    names = OCCURRENCE if halves else OCCURRENCE[: OCCURRENCE.index(", k0")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _each(batches):
            out, alone = lines.size < exact_chars, lines.size < min_chars
            hashes = [lines.hash(lines.start, lines.end), lines.second(), *(lines.halves() if halves else [])]
            columns = [ids.take(pa.array(lines.doc)), pa.array(lines.number, pa.int32()), *(pa.array(x.view(np.int64), mask=alone if k > 1 else out) for k, x in enumerate(hashes))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in names.split(", ")])

    return written(docs.mapInArrow(scan, names).withColumn("row", F.monotonically_increasing_id()), "line-places")


def _segments(n: np.ndarray, edits: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For lines of n characters: (own, lines, tag, begin, size) of the substrings that may be a segment of a line up to `edits` shorter.

    If two lines are within the bound, one of the shorter's edits + 1 segments is such a substring of the longer with the same tag, for of the segments
    that match some has as many edits before it as its number at most and as many after it as segments follow. own: the line's own segments.
    """
    parts = edits + 1
    for less in range(edits + 1):
        length = n - less
        for i in range(parts):
            size = length // parts + (i >= parts - length % parts)
            place = length // parts * i + np.maximum(0, i - (parts - length % parts))
            for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                begin = place + move
                lines = np.flatnonzero((length >= 0) & (begin >= 0) & (begin + size <= n))
                yield less == 0 and move == 0, lines, (length * parts + i)[lines].astype(np.uint64), begin[lines], size[lines]


def _keys(docs: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """(key, h): the keys of each line's substrings. The lowest bit of h is replaced: 1 for the line's own segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lines in _each(batches):
            h = lines.hash(lines.start, lines.end) & ~np.uint64(1)
            pick = np.flatnonzero(lines.size >= min_chars)
            pick = pick[np.unique(h[pick], return_index=True)[1]]
            base = lines.signs[lines.start[pick]]
            for own, some, tag, begin, size in _segments(lines.size[pick], edits):
                first = lines.at[base[some] + begin]
                with np.errstate(over="ignore"):
                    key = textvec.mix(lines.hash(first, np.where(size > 0, lines.at[base[some] + begin + size], first)) * np.uint64(7) + textvec.mix(tag))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((h[pick[some]] | np.uint64(own)).view(np.int64))], names=["key", "h"])

    return docs.mapInArrow(scan, "key long, h long")


def _sharing(keys: DataFrame) -> DataFrame:
    """(half_h): of the lines one of whose keys is another distinct line's segment, or one of whose segments is another's key, the hash without its lowest bit."""
    row = written(keys.select("key", F.shiftright("h", 1).alias("half_h"), (F.col("h").bitwiseAND(F.lit(1)) == 1).alias("own")), "line-segments")
    mine = F.when(F.col("own"), F.col("half_h"))
    by_key = row.groupBy("key").agg(F.min("half_h").alias("low"), F.max("half_h").alias("high"), F.min(mine).alias("own_low"), F.max(mine).alias("own_high"))
    met = row.join(by_key.where("low <> high and own_low is not null"), "key")
    return met.where("own or own_low <> half_h or own_high <> half_h").select("half_h").distinct()


def _sketched(edits: int):
    """Of lines: (place, key, own, one, two) for each key; one and two are the parities of 64 classes of characters and of neighbours.

    A substitution changes 2 parities of `one` and 4 of `two` at most; the other edits change fewer.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("line").to_pylist()
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (held == 0 or held + len(texts[j]) < 500_000):
                    held += len(texts[j])
                    j += 1
                n = np.array([len(t) for t in texts[i:j]], np.int64)
                raw = np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), np.uint8)
                code = raw.view(np.uint32).astype(np.uint64) + np.uint64(1)
                start = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    bits = [textvec.mix(code), textvec.mix(code[:-1] * np.uint64(SECOND) + code[1:])]
                    xor = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (b >> np.uint64(58)))]) for b in bits]
                    one = xor[0][start + n] ^ xor[0][start]
                    two = np.where(n > 1, xor[1][np.maximum(start + n - 1, 0)] ^ xor[1][np.minimum(start, len(xor[1]) - 1)], np.uint64(0))
                places = batch.column("place").slice(i, j - i)
                for own, some, tag, begin, size in _segments(n, edits):
                    first = start[some] + begin
                    with np.errstate(over="ignore"):
                        key = textvec.mix(textvec.span_hashes(raw, 4 * first, 4 * (first + size)) * np.uint64(7) + textvec.mix(tag))
                    columns = [places.take(pa.array(some)), pa.array(key.view(np.int64)), pa.array(np.full(len(some), own)), pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "key", "own", "one", "two"])
                i = j

    return scan


def _filter(left: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, in 64-bit numbers, of which those of the lines' hashes are set."""
    at = F.shiftrightunsigned("h", 64 - bits)
    one = left.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS int))").alias("bit"))
    got = one.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _texts(docs: DataFrame, min_chars: int, passing: np.ndarray) -> DataFrame:
    """(h, g, place, line) of the lines that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(passing)
    bits = 6 + (len(passing).bit_length() - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lines in _each(batches):
            h = lines.hash(lines.start, lines.end)
            at = h >> np.uint64(64 - bits)
            pick = np.flatnonzero((lines.size >= min_chars) & ((sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0))
            text = [lines.data[a:b].tobytes().decode("utf-8") for a, b in zip(lines.start[pick], lines.end[pick])]
            second = lines.hash(lines.start[pick], lines.end[pick], SECOND)
            columns = [ids.take(pa.array(lines.doc[pick])), pa.array(lines.number[pick], pa.int32()), pa.array(h[pick].view(np.int64)), pa.array(second.view(np.int64)), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "h", "g", "line"])

    return docs.mapInArrow(scan, "doc_id long, line_no int, h long, g long, line string").select("h", "g", _place().alias("place"), "line")


def _place() -> Column:
    """Orders places: a null id last."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"))


def _sums(code: np.ndarray, begin: np.ndarray, n: np.ndarray, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, and of each line less one character, a hash of 62 bits: sums of powers modulo a prime by two bases, so that parts can be put together."""
    whole, gone = np.zeros(len(n), np.uint64), np.zeros(len(code), np.uint64)
    for shift, (base, inverse) in zip((np.uint64(0), np.uint64(31)), _BASES):
        power = np.ones(max(1, int(n.max(initial=0))), np.uint64)
        size = 1
        while size < len(power):
            power[size : 2 * size] = power[: min(size, len(power) - size)] * np.uint64(pow(base, size, int(_PRIME))) % _PRIME
            size *= 2
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code % _PRIME * power[at] % _PRIME)])
        whole |= (total[begin + n] - total[begin]) % _PRIME << shift
        after = (total[begin[line] + n[line]] - total[1:]) % _PRIME * np.uint64(inverse) % _PRIME
        gone |= (total[:-1] - total[begin[line]] + after) % _PRIME << shift
    return whole, gone


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, key, kind): of lines that a longer line may become (kind 0), their own key; of lines that may become a shorter one
    (kind 1), that of each variant with one character deleted; of lines with partners of their length (kind 2), that of each variant and its place.

    Characters are code points. The hash of a line without character i is that of what stands before it and of what follows moved by one.
    """
    for batch in batches:
        texts = batch.column("line").to_pylist()
        may = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("shorter", "longer", "equal")]
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (held == 0 or held + len(texts[j]) < 500_000):
                held += len(texts[j])
                j += 1
            n = np.array([len(t) for t in texts[i:j]])
            code = np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            begin = np.cumsum(n) - n
            line = np.repeat(np.arange(j - i), n)
            at = np.arange(len(code)) - begin[line]
            again = np.append(False, code[1:] == code[:-1]) & (at > 0)  # deleting either of two equal neighbours is the same
            with np.errstate(over="ignore"):
                whole, gone = _sums(code, begin, n, line, at)
                size = n.astype(np.uint64)
                own = textvec.mix(whole * np.uint64(3) + textvec.mix(size))
                deleted = textvec.mix(gone * np.uint64(3) + textvec.mix(size[line] - np.uint64(1)))
                placed = textvec.mix(gone * np.uint64(5) + textvec.mix(at.astype(np.uint64) * np.uint64(2654435761) + size[line]) + np.uint64(1))
            short, long, same = (m[i:j] for m in may)
            picks = [np.flatnonzero(short), np.flatnonzero(long[line] & ~again), np.flatnonzero(same[line])]
            line_of = np.concatenate([picks[0], line[picks[1]], line[picks[2]]])
            keys = np.concatenate([own[picks[0]], deleted[picks[1]], placed[picks[2]]]).view(np.int64)
            kind = np.repeat(np.arange(3, dtype=np.int8), [len(p) for p in picks])
            places = batch.column("place").slice(i, j - i).take(pa.array(line_of))
            yield pa.RecordBatch.from_arrays([places, pa.array(keys), pa.array(kind)], names=["place", "key", "kind"])
            i = j


def _partners(distinct: DataFrame) -> DataFrame:
    """(h, shorter, longer, equal): the lines that share a half with a line of a fitting length; flags say as which of a pair."""
    halved = distinct.where("k0 is not null").select("h", F.explode(F.array(*(F.struct(F.col(f"k{k}").alias("half"), F.lit(k > 1).alias("more")) for k in range(4)))).alias("x")).select("h", "x.half", "x.more")
    full = F.when(~F.col("more"), F.col("h"))
    by_half = halved.groupBy("half").agg(F.min(full).alias("least"), F.max(full).alias("most"), F.max("more").alias("less"))
    seen = halved.join(by_half.where("least is not null and (less or least <> most)"), "half")
    flags = seen.select("h", F.col("more").alias("shorter"), (~F.col("more") & F.col("less")).alias("longer"), (~F.col("more") & (F.col("least") != F.col("most"))).alias("equal"))
    return flags.groupBy("h").agg(*(F.max(c).alias(c) for c in ("shorter", "longer", "equal")))


def _star_pairs(text: DataFrame) -> DataFrame:
    """(place, other): lines and earlier ones that may be one edit away, the earliest such of each group."""
    keyed = written(text.mapInArrow(_variants, T.StructType([text.schema["place"], T.StructField("key", T.LongType()), T.StructField("kind", T.ByteType())])), "line-variants")
    # Kind 0 meets kind 1, and kind 2 meets kind 2: the candidate is the earliest on the other side.
    of = lambda f, k: f(F.when(F.col("kind") == k, F.col("place")))
    by_key = keyed.groupBy("key").agg(of(F.min, 0).alias("whole"), of(F.min, 1).alias("deleted"), of(F.min, 2).alias("placed"), of(F.max, 2).alias("last"))
    met = keyed.join(by_key.where("(whole is not null and deleted is not null) or placed <> last"), "key")
    offered = met.select("place", F.when(F.col("kind") == 0, F.col("deleted")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("placed")).alias("other")).where("other < place")
    return offered.distinct()


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are within the bound, by the furthest place of each diagonal for each number of edits; runs of equal characters are compared as slices."""
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False

    def slide(i: int, j: int) -> int:
        size, most = 16, min(n - i, m - j)
        done = 0
        while done < most and size:
            step = min(size, most - done)
            if a[i + done : i + done + step] == b[j + done : j + done + step]:
                done += step
                size *= 2
            elif step == 1:
                break
            else:
                size = step // 2
        return i + done

    reach = {0: slide(0, 0)}
    if n == m == reach[0]:
        return True
    for _ in range(edits):
        ahead = {}
        for d in range(min(reach) - 1, max(reach) + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= 0 and i + d >= 0:
                ahead[d] = slide(i, i + d)
        if ahead.get(m - n) == n:
            return True
        reach = ahead
    return False


def _verified(edits: int):
    """Of pairs with the texts of both, (h, g, other) of those within the bound. Spark's levenshtein is quadratic in the length of a line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [within(a.as_py(), b.as_py(), edits) for a, b in zip(batch.column("line"), batch.column("other_line"))]
            yield batch.filter(pa.array(stay, pa.bool_())).select(["h", "g", "other"])

    return scan


def _segment_pairs(text: DataFrame, edits: int) -> DataFrame:
    """(place, other): lines and all earlier ones that share a segment, and whose sketches allow the bound."""
    bit = T.StructType([text.schema["place"], T.StructField("key", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())])
    keyed = written(text.mapInArrow(_sketched(edits), bit), "line-keys")
    mine = keyed.where("own").select("key", F.col("place").alias("p"), F.col("one").alias("one_p"), F.col("two").alias("two_p"))
    fits = (F.bit_count(F.col("one").bitwiseXOR(F.col("one_p"))) <= 2 * edits) & (F.bit_count(F.col("two").bitwiseXOR(F.col("two_p"))) <= 4 * edits)
    met = keyed.drop("own").join(mine.hint("merge"), "key").where(fits & (F.col("place") != F.col("p")))
    return met.select(F.greatest("place", "p").alias("place"), F.least("place", "p").alias("other")).distinct()


def find_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 12, edits: int = 1, exact_chars: int | None = None, filter_bits: int = 26) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, keep) for every line: the place of the earliest line within `edits` edits, its own if it is that."""
    if edits < 1 or not 6 <= filter_bits <= 32:
        raise ValueError("edits must be 1 or more, filter_bits 6 to 32")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    halves = edits == 1
    places = _occurrences(rows, min_chars, halves, min_chars if exact_chars is None else min(exact_chars, min_chars))
    part = places.where("h is not null")
    # Rows that repeat have the same places; the row tells which of them is the first.
    rowed = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("row").alias("r"))
    collapsed = part.groupBy("h", "g").agg(F.min(rowed).alias("at"), *(F.first(f"k{k}").alias(f"k{k}") for k in range(4 * halves)))
    place = F.struct(F.col("at.no").alias("no"), F.col("at.d").alias("d"), F.col("at.l").alias("l"))
    distinct = written(collapsed.withColumns({"place": place, "row": F.col("at.r")}).drop("at"), "line-distinct")
    if halves:
        left = distinct.select("h", "g", "place").join(_partners(distinct), "h")
    else:
        sharing = written(_sharing(_keys(rows, min_chars, edits)), "line-sharing")
        left = distinct.select("h", "g", "place").join(sharing, F.shiftright("h", 1) == F.col("half_h")).drop("half_h")
    left = written(left, "line-candidates")
    text = _texts(rows, min_chars, _filter(left, filter_bits)).join(left, ["h", "g", "place"]).dropDuplicates(["h", "g"])
    text = written(text, "line-left")
    pairs = _star_pairs(text) if edits == 1 else _segment_pairs(text, edits)
    theirs = text.select(F.col("place").alias("other"), F.col("line").alias("other_line"))
    both = pairs.join(text.select("h", "g", "place", "line"), "place").join(theirs, "other").select("h", "g", "other", "line", "other_line")
    close = both.mapInArrow(_verified(edits), both.select("h", "g", "other").schema)
    close = close.groupBy("h", "g").agg(F.min("other").alias("other"))
    nearer = F.coalesce(F.col("other") < F.col("place"), F.lit(False))
    fate = distinct.select("h", "g", "place", "row").join(close, ["h", "g"], "left")
    fate = fate.select("h", "g", F.when(nearer, F.col("other")).otherwise(F.col("place")).alias("first"), F.when(~nearer, F.col("row")).alias("keeper"))
    # The lines' places are joined with the fates by shuffle at every size, for both grow with the lines; nothing follows, so a hot line can be split.
    joined = part.select("doc_id", "line_no", "h", "g", "row").join(fate.hint("merge"), ["h", "g"])
    kept = joined.select("doc_id", "line_no", F.col("first.d").alias("first_doc_id"), F.col("first.l").alias("first_line_no"), F.coalesce(F.col("row") == F.col("keeper"), F.lit(False)).alias("keep"))
    short = places.where("h is null").select("doc_id", "line_no", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"), F.lit(True).alias("keep"))
    return kept.union(short)
