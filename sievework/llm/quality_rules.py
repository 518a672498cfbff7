"""Hashed word and character n-gram logistic regression, calibrated, scored in Arrow batches against a fixed threshold.

Features of a whole text, hashed into 2**18 places: word unigrams and bigrams (lower case; a word that repeats the one
before counts as one mark, whatever the word) and byte trigrams and 5-grams (case kept). A feature's value is its share among
the n-grams of its kind and 20 neutral ones (a text of a few words is judged mildly), so the score is a sum of four means and needs one pass over the bytes and no table per document.
Weights are fitted by logistic regression on half of a sample of labelled rows bounded by `per_class`, the calibration (Platt's)
on the other half. The tasks leave the sample's vectors as files in the shared folder, no text's taking more than 1 MB, and the driver gets their
names: vectors of `in_memory` bytes together are held there, more are read anew in each round of the fit, so texts of any length and variety take part whole.
What goes to the tasks is the weights, 1 MB whatever the size of the corpus. Texts beyond LONG bytes are gone through by parts, of which no n-gram is lost.

Defined results: a null, empty or blank text has no score (null) and is not kept. Where the labels lack a class there is no model:
scores are null and every document with text is kept. Rows that repeat, and ties, are scored each by itself. A text of any length is scored whole.
Other columns take no part and are returned as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sievework.llm import labelled, textvec
from sievework.llm.shared import fresh, open_fs, remove

SPACE = 1 << 18
#: p(good) from which a document is kept. Below a half, for a good document lost costs more than a bad one kept.
THRESHOLD = 0.3
#: n-grams of weight 0 that each kind has besides a text's own.
NEUTRAL = 20
#: Bytes of text taken at once.
LONG = 1 << 20
#: Places from which a text's vector is a row of all SPACE values, which is quicker to multiply and 1 MB at the most.
DENSE = 1 << 15
#: Bytes of vectors in a file.
BLOCK = 8 << 20


def _places(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (textvec.mix(hashes + np.uint64(kind)) >> np.uint64(46)).astype(np.int64)


#: Kind and length of the byte n-grams.
BYTE_GRAMS = ((3, 3), (4, 5))


def _pairs(word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.where(word[:-1] == word[1:], np.uint64(7), word[:-1] * np.uint64(3) + word[1:] * np.uint64(5))


def _codes(wide: np.ndarray, n: int) -> np.ndarray:
    count = max(0, len(wide) - n + 1)
    code = np.zeros(count, np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | wide[k : k + count]
    return code


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind, the place of every n-gram in order of the texts, and the index of the first of each text."""
    word, first = textvec.words(data, offs)
    yield _places(word, 1), first
    if len(word):
        pair = _pairs(word)
        inside = np.ones(len(word), bool)
        inside[first[1:][first[1:] > 0] - 1] = False  # a text's last word begins no pair
        at = np.flatnonzero(inside)
        yield _places(pair[at], 2), np.searchsorted(at, first)
    else:
        yield np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    wide = data.astype(np.uint64)
    for kind, n in BYTE_GRAMS:
        code = _codes(wide, n)
        count = len(code)
        lens = np.maximum(0, np.diff(offs) - n + 1)
        begin = np.concatenate([[0], np.cumsum(lens)])
        if begin[-1] != count:  # n-grams across two texts go
            doc = np.repeat(np.arange(len(lens)), lens)
            code = code[np.arange(begin[-1]) - begin[doc] + offs[doc]]
        yield _places(code, kind), begin


def long_grams(data: np.ndarray, limit: int = LONG) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, places) of one text's n-grams by parts of about `limit` bytes; a word isn't cut, so a longer one is a part of its own."""
    at, last = 0, np.zeros(0, np.uint64)
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and textvec.WORD_BYTE[data[end]]:
            rest = np.flatnonzero(~textvec.WORD_BYTE[data[end : end + limit]])
            end = end + int(rest[0]) if len(rest) else min(end + limit, len(data))
        word, _ = textvec.words(data[at:end], np.array([0, end - at]))
        yield 1, _places(word, 1)
        word = np.concatenate([last, word])
        yield 2, _places(_pairs(word), 2)
        at, last = end, word[-1:]
    for kind, n in BYTE_GRAMS:
        for i in range(0, len(data) - n + 1, limit):
            yield kind, _places(_codes(data[i : i + limit + n - 1].astype(np.uint64), n), kind)


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[first[1:]] - total[first[:-1]]) / (NEUTRAL + np.diff(first))


def raw_scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The linear score of each text."""
    out = np.zeros(len(offs) - 1)
    for i, j in textvec.pieces(offs, LONG):
        if offs[j] - offs[i] > LONG:  # one text
            total, count = np.zeros(5), np.zeros(5, np.int64)
            for kind, place in long_grams(data[offs[i] : offs[j]]):
                total[kind] += weights[place].sum(dtype=np.float64)
                count[kind] += len(place)
            out[i] = (total / (NEUTRAL + count)).sum()
            continue
        part = np.zeros(j - i)
        for place, first in grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
            part += _means(weights[place], first)
        out[i:j] = part
    return out


def _vector(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one text: of each kind of n-gram its places in order, or each place once with its sum if the text is long."""
    if len(data) > LONG:
        counts = np.zeros((5, SPACE), np.int64)
        for kind, place in long_grams(data):
            counts[kind] += np.bincount(place, minlength=SPACE)
        total = (counts / (NEUTRAL + counts.sum(axis=1))[:, None]).sum(axis=0)
        at = np.flatnonzero(total)
        return at.astype(np.int32), total[at].astype(np.float32)
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for place, _ in grams(data, np.array([0, len(data)])):
        if len(place):
            at, n = np.unique(place, return_counts=True)
            own.append((at, n / (NEUTRAL + len(place))))
    if not own:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate([a for a, _ in own]).astype(np.int32), np.concatenate([v for _, v in own]).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature vectors of the sample."""
    for batch in batches:
        data, offs = textvec.utf8(batch.column("text"))
        for i, j in textvec.pieces(offs, LONG):
            own = [_vector(data[offs[k] : offs[k + 1]]) for k in range(i, j)]
            columns = [*(batch.column(c).slice(i, j - i) for c in ("id", "good", "fold")), pa.array([p.tobytes() for p, _ in own], pa.binary()), pa.array([v.tobytes() for _, v in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "good", "fold", "places", "values"])


#: A file of vectors: its name, and of each of its texts id, class and number of places, or -1 for a row of all SPACE values.
_FILE = "file string, ids array<long>, good array<int>, sizes array<int>"


def _save(uri: str, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Write the places, the values and then the full rows; a task that is run twice leaves a file that nobody names."""
    rows = sorted(rows, key=lambda r: len(r[2]) < len(r[3]))  # full rows last
    name, (where, path) = f"{uuid.uuid4().hex}.bin", open_fs(uri)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{name}") as out:
        for part in (*(p for _, _, p, _ in rows), *(v for _, _, p, v in rows if len(p)), *(v for _, _, p, v in rows if not len(p))):
            out.write(part.tobytes())
    sizes = [len(p) if len(p) or not len(v) else -1 for _, _, p, v in rows]
    columns = [pa.array([name]), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "ids", "good", "sizes"])


def _saved(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """The vectors in files of about BLOCK bytes."""
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in _vectors(batches):
        for key, good, p, v in zip(*(batch.column(c).to_pylist() for c in ("id", "good", "places", "values"))):
            places, values = np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)
            if len(places) > DENSE:
                places, values = places[:0], np.bincount(places, values, SPACE).astype(np.float32)
            held.append((key, good, places, values))
            size += places.nbytes + values.nbytes
            if size >= BLOCK:
                yield _save(uri, held)
                held, size = [], 0
    if held:
        yield _save(uri, held)


def _opened(uri: str, row: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A file's sizes, and its places, values and full rows."""
    where, path = open_fs(uri)
    if isinstance(where, fs.LocalFileSystem):
        where = fs.LocalFileSystem(use_mmap=True)
    sizes = np.array(row.sizes, np.int64)
    n = int(sizes[sizes > 0].sum())
    with where.open_input_file(f"{path}/{row.file}") as file:
        raw = file.read_buffer()
    if not raw.size:
        return sizes, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, SPACE), np.float32)
    return sizes, np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.float32, n, 4 * n), np.frombuffer(raw, np.float32, -1, 8 * n).reshape(-1, SPACE)


def _descend(slopes: Callable[[np.ndarray, float], np.ndarray], n: int, rounds: int, rate: float) -> np.ndarray:
    """n weights by Adam's steps; slopes gives the full gradient at weights and bias, the bias's last."""
    w, bias, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        g = slopes(w, bias)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= step[:-1]
        bias -= step[-1]
    return w


def _class_weights(good: np.ndarray) -> np.ndarray:
    return np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))


def fit(places: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression by full gradients with Adam's steps; both classes weigh the same."""
    lens = np.array([len(p) for p in places])
    at, x = np.concatenate(places), np.concatenate(values)
    used = np.flatnonzero(np.bincount(at, minlength=SPACE))
    number = np.zeros(SPACE, np.int32)
    number[used] = np.arange(len(used))
    at = number[at]
    cut = np.concatenate([[0], np.cumsum(lens)])
    weight = _class_weights(good)

    def slopes(w: np.ndarray, bias: float) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x * w[at])])
        slope = weight * (labelled.sigmoid(total[cut[1:]] - total[cut[:-1]] + bias) - good)
        return np.append(np.bincount(at, x * np.repeat(slope, lens), len(used)) + ridge * w, slope.sum())

    out = np.zeros(SPACE, np.float32)
    out[used] = _descend(slopes, len(used), rounds, rate)
    return out


def fit_files(uri: str, files: list[Row], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-6) -> np.ndarray:
    """As fit, of vectors in files, which are read one after another in each round."""
    good = np.concatenate([r.good for r in files]) == 1
    weight, begin = _class_weights(good), np.concatenate([[0], np.cumsum([len(r.good) for r in files])])

    def slopes(w: np.ndarray, bias: float) -> np.ndarray:
        g, narrow = np.append(ridge * w, 0.0), w.astype(np.float32)
        for row, i, j in zip(files, begin[:-1], begin[1:]):
            sizes, at, x, full = _opened(uri, row)
            lens = sizes[sizes >= 0]
            cut = np.concatenate([[0], np.cumsum(lens)])
            total = np.concatenate([[0.0], np.cumsum(x * w[at])])
            z = np.concatenate([total[cut[1:]] - total[cut[:-1]], full @ narrow])
            slope = weight[i:j] * (labelled.sigmoid(z + bias) - good[i:j])
            if len(at):
                g[:-1] += np.bincount(at, x * np.repeat(slope[: len(lens)], lens), SPACE)
            if len(full):
                g[:-1] += slope[len(lens) :].astype(np.float32) @ full
            g[-1] += slope.sum()
        return g

    return _descend(slopes, SPACE, rounds, rate).astype(np.float32)


def train(documents: DataFrame, labels: DataFrame, *, per_class: int = 1500, seed: int = 23, in_memory: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, list[float]] | None:
    """Weights and calibration; None without rows of both classes in both folds."""
    rows = labelled.sample(documents, labels, per_class, seed, id_col=id_col, text_col=text_col)
    # Of the half that is fitted the driver gets the files' names; the other is scored where it is.
    uri = fresh(documents.sparkSession, "rules-vectors")
    files = rows.where("fold = 0").mapInArrow(lambda batches: _saved(batches, uri), _FILE).collect()
    files.sort(key=lambda r: (r.ids, r.sizes))
    good = np.concatenate([np.zeros(0, int), *(r.good for r in files)]) == 1
    if not len(good) or good.all() or not good.any():
        return None
    if sum(4 * SPACE if n < 0 else 8 * n for r in files for n in r.sizes) <= in_memory:
        weights = _fit_held(uri, files)
    else:
        weights = fit_files(uri, files)
    remove(uri)

    def held_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(raw_scores(*textvec.utf8(batch.column("text")), weights))], names=["good", "score"])

    held = rows.where("fold = 1").mapInArrow(held_scores, "good int, score double").toPandas().sort_values(["score", "good"])
    calibration = labelled.fit_logistic(held[["score"]].to_numpy(), held["good"].to_numpy() == 1, ridge=1e-6)
    return None if calibration is None else (weights, calibration.tolist())


def _fit_held(uri: str, files: list[Row]) -> np.ndarray:
    """fit of all the files' vectors, in the order of the ids."""
    own = []
    for row in files:
        sizes, at, x, full = _opened(uri, row)
        cut = np.concatenate([[0], np.cumsum(sizes[sizes >= 0])])
        sparse = [(at[i:j].copy(), x[i:j].copy()) for i, j in zip(cut[:-1], cut[1:])]
        sparse += [(np.flatnonzero(f).astype(np.int32), f[f != 0]) for f in full]
        own += [(key, p.tobytes(), p, v, g) for key, g, (p, v) in zip(row.ids, row.good, sparse)]
    own.sort(key=lambda r: r[:2])
    return fit([r[2] for r in own], [r[3] for r in own], np.array([r[4] for r in own]) == 1)


def apply_rules(docs: DataFrame, model: tuple[np.ndarray, list[float]] | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with their columns packed in `row`, and score and keep."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0]) if model else None
    slope, offset = model[1] if model else (0.0, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text in labelled.row_texts(batches, text_at):
            data, offs = textvec.utf8(text)
            has = labelled.has_text(text)
            if weights is None:
                p, keep, none = np.zeros(len(has)), has, np.ones(len(has), bool)
            else:
                p = labelled.sigmoid(raw_scores(data, offs, weights.value) * slope + offset)
                keep, none = has & (p >= threshold), ~has
            yield pa.RecordBatch.from_arrays([row, pa.array(p, mask=none), pa.array(keep)], names=["row", "score", "keep"])

    packed, text_at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    return packed.mapInArrow(score, packed.select("row").schema.add("score", "double").add("keep", "boolean"))


def classify_documents(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) for each document."""
    model = train(documents, labels, id_col=id_col, text_col=text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return apply_rules(rows, model).select("row.doc_id", "score", "keep")


def keep_good(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules, trained on labelled `documents`, keep."""
    return apply_rules(docs, train(documents, labels)).where("keep").select("row.*")
