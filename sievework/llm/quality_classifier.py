"""Compression classifier: zstandard dictionaries of good and of bad labelled text; the size difference becomes a calibrated score.

Every text is cut into pieces of `piece` bytes and each piece is compressed with either dictionary, so the evidence of
the whole text counts, not only its beginning. With g and b the two sums, d = (g - b) / (max(g, b) + 192) is the normalised
difference. A logistic function of d and of the log compression ratio log((g + 192) / (bytes + 192)) is fitted on the half of the
sample that the dictionaries haven't seen: text that repeats itself shrinks to nothing with any dictionary, which
the difference alone can't show. The dictionaries (fixed size) and four weights go to the tasks; the sample of
labelled rows is bounded by `per_class`, and of each class's half of it the dictionary sees `pieces_per_class` pieces at most, drawn by hash
over whole texts: of long documents most of the text isn't among them. Where zstandard refuses to train on them, for they are too few, all their text is the
dictionary.

Defined results: a null, empty or blank text has no score (null) and is not kept. Where the labels lack a class there is no model:
scores are null and every document with text is kept. Rows that repeat, and ties, are scored each by itself. A text of any length is scored whole.
Other columns take no part and are returned as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import labelled, textvec

#: p(good) from which a document is kept. Below a half, for a good document lost costs more than a bad one kept.
THRESHOLD = 0.3
#: Bytes added to both sizes, so that a short text is judged mildly.
SMOOTH = 192
PIECE = 1024


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(raw)
    words.precompute_compress(level=1)
    return zstandard.ZstdCompressor(level=1, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts: Iterable[bytes], good: bytes, bad: bytes, piece: int = PIECE) -> np.ndarray:
    """(normalised difference, log ratio) of each text."""
    g, b = _compressor(good), _compressor(bad)
    out = []
    for text in texts:
        x = y = 0
        for at in range(0, len(text), piece):
            part = text[at : at + piece]
            x += len(g.compress(part))
            y += len(b.compress(part))
        out.append(((x - y) / (max(x, y) + SMOOTH), np.log((x + SMOOTH) / (len(text) + SMOOTH))))
    return np.array(out).reshape(-1, 2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece of every text with a hash of its place, to draw from."""
    import xxhash

    for batch in batches:
        rows = []
        for key, text, good in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "good"))):
            raw = text.encode()
            rows += [(good, xxhash.xxh3_64_intdigest(f"{key}:{at}") >> 1, raw[at : at + PIECE]) for at in range(0, len(raw), PIECE)]
        good, order, raw = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(order, pa.int64()), pa.array(raw, pa.binary())], names=["good", "order", "raw"])


def _own_lines(rows: DataFrame) -> DataFrame:
    """The sample's texts without the lines that two of its documents share: boilerplate and copies tell nothing of the class."""
    lines = rows.select("id", "good", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    shared = lines.groupBy("line").agg(F.countDistinct("id").alias("n")).where("n > 1").select("line")
    own = lines.join(shared, "line", "left_anti").groupBy("id", "good").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("kept"))
    return own.select("id", "good", F.array_join(F.col("kept.line"), "\n").alias("text"))


def train(documents: DataFrame, labels: DataFrame, *, per_class: int = 3000, pieces_per_class: int = 4000, dictionary_bytes: int = 65_536, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, bytes, list[float]] | None:
    """Dictionaries of good and of bad text, and the calibration's weights; None without rows of both classes."""
    rows = labelled.sample(documents, labels, per_class, seed, id_col=id_col, text_col=text_col)
    pieces = _own_lines(rows.where("fold = 0")).mapInArrow(_pieces, "good int, order long, raw binary")
    dictionary: dict[int, bytes] = {}
    for c in (0, 1):
        drawn = [bytes(r["raw"]) for r in pieces.where(F.col("good") == c).orderBy("order", "raw").limit(pieces_per_class).collect()]
        if not drawn:
            return None
        try:
            dictionary[c] = zstandard.train_dictionary(dictionary_bytes, drawn, level=3).as_bytes()
        except zstandard.ZstdError:  # too few pieces to train on: all their text serves
            dictionary[c] = b"".join(drawn).ljust(8, b" ")
    good, bad = dictionary[1], dictionary[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t.encode() for t in batch.column("text").to_pylist()], good, bad)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["good", "d", "r"])

    held = rows.where("fold = 1").mapInArrow(measure, "good int, d double, r double").toPandas().sort_values(["d", "r", "good"])
    w = labelled.fit_logistic(held[["d", "r"]].to_numpy(), held["good"].to_numpy() == 1, ridge=1e-5)
    return None if w is None else (good, bad, w.tolist())


def classify(docs: DataFrame, model: tuple[bytes, bytes, list[float]] | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with their columns packed in `row`, and size_difference, score and keep."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text in labelled.row_texts(batches, text_at):
            data, offs = textvec.utf8(text)
            has = labelled.has_text(text)
            d, p, keep = np.zeros(len(has)), np.zeros(len(has)), has.copy()
            if model is not None and has.any():
                x = features((data[offs[i] : offs[i + 1]].tobytes() for i in np.flatnonzero(has)), model[0], model[1])
                d[has] = x[:, 0]
                p[has] = labelled.sigmoid(x @ np.array(model[2][:-1]) + model[2][-1])
                keep[has] = p[has] >= threshold
            none = ~has if model is not None else np.ones(len(has), bool)
            yield pa.RecordBatch.from_arrays([row, pa.array(d, mask=none), pa.array(p, mask=none), pa.array(keep)], names=["row", "size_difference", "score", "keep"])

    packed, text_at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    return packed.mapInArrow(score, packed.select("row").schema.add("size_difference", "double").add("score", "double").add("keep", "boolean"))


def classify_documents(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size_difference, score, keep) for each document."""
    model = train(documents, labels, id_col=id_col, text_col=text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return classify(rows, model).select("row.doc_id", "size_difference", "score", "keep")


def keep_good(docs: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier, trained on labelled `documents`, keeps."""
    return classify(docs, train(documents, labels)).where("keep").select("row.*")
