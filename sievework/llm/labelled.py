"""Bounded samples of labelled documents, and the logistic calibration that both quality operators use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import written


def sample(documents: DataFrame, labels: DataFrame, per_class: int, seed: int, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """(id, text, good, fold) of at most `per_class` labelled documents of each class, those of the least seeded hash, in the shared folder.

    Only labels 0 and 1 count; a document with both is bad. Folds 0 and 1 halve the sample by another hash. The ids are
    bounded by the parameter, so they are broadcast.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    picked = [ids.where(F.col("good") == c).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(per_class) for c in (0, 1)]
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked[0].union(picked[1])), "id")
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2)).cast("int")
    return written(joined.select("id", "text", "good", fold.alias("fold")), "labelled")


#: Rows that a scoring task takes at once.
ROWS = 1000


def row_texts(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of the packed rows, and the texts inside them, so that no text is sent to Python twice or copied for a whole batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            row = batch.column(0).slice(i, ROWS)
            yield row, row.field(text_at).cast(pa.string())


def has_text(texts: pa.Array) -> np.ndarray:
    """Whether each is neither null, empty nor blank."""
    blank = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.utf8_is_space(texts))
    return pc.invert(pc.fill_null(blank, True)).to_numpy(zero_copy_only=False)


def fit_logistic(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray | None:
    """Weights of p(good) = sigmoid(x @ w[:-1] + w[-1]) by Newton's method, both classes weighing the same; None where one is absent.

    The targets are Platt's, a little inside 0 and 1, so separable data give finite weights.
    """
    n1, n0 = int(good.sum()), int((~good).sum())
    if not n1 or not n0:
        return None
    design = np.column_stack([x, np.ones(len(x))])
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / n1, 0.5 / n0)
    w = np.zeros(design.shape[1])
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (weight * (p - target)) + hold * w
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(hold + 1e-9)
        move = np.linalg.solve(bend, slope)
        move *= min(1.0, 10 / max(1e-12, np.abs(move).max()))
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
