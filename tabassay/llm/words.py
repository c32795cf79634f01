"""Words of texts as bytes, cut out a bounded block of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Every byte of a word in lower case (digits, letters, all of a non-ASCII character), else a blank.
_KEPT = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def text_blocks(
    batch: pa.RecordBatch, text_col: str = "text", most: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows of about ``most`` bytes of text, with the texts; null is empty."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy()
    block = np.cumsum(sizes, dtype=np.int64) // most
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        own = batch.slice(start, end - start)
        yield own, [t or b"" for t in own.column(text_col).cast(pa.binary()).to_pylist()]


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of each word in turn, the distinct words, and how many words each text has."""
    cut = [text.translate(_KEPT).split() for text in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    every = np.empty(int(counts.sum()), dtype=object)
    every[:] = [word for words in cut for word in words]
    numbers, distinct = pd.factorize(every)
    return numbers.astype(np.int64), list(distinct), counts
