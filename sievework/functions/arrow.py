"""Arrow arrays gone through by pieces, so that what a task holds in Python doesn't follow the size of Spark's batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or words, taken at once.
BYTES, WORDS = 1 << 21, 1 << 17


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` in all; a larger row is a range of its own."""
    i, end = 0, np.cumsum(sizes)
    while i < len(end):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def slices(rows: pa.Array) -> Iterator[pa.Array]:
    """A column of texts, or of lists of words, by pieces."""
    lists = pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type)
    size = pc.list_value_length(rows) if lists else pc.binary_length(rows)
    for i, j in cuts(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64), WORDS if lists else BYTES):
        yield rows.slice(i, j - i)


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
