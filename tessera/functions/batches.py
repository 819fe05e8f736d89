"""Arrow batches in bounded pieces, so that what a task of Python holds does not grow with the rows that Spark puts in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 1 << 20


def _cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows from and to, each run of at most ``MOST_BYTES`` or one row."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > MOST_BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose column ``at``, of texts or lists of them, has at most ``MOST_BYTES``; a longer row is one of its own."""
    for batch in batches:
        column = batch.column(at)
        each = -(-batch.nbytes // max(batch.num_rows, 1))  # of columns that are no texts the mean
        texts = pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)
        sizes = [n or 0 for n in pc.binary_length(column).to_pylist()] if texts else [each] * batch.num_rows
        for begin, end in _cuts(sizes):
            yield batch.slice(begin, end - begin)


def each_text(of: Callable[[str | None], object]) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """``of`` every text of a column, for a pandas function over iterators; what goes back is as bounded as what is read."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            for begin, end in _cuts([len(t or "") for t in column]):
                yield column.iloc[begin:end].map(of)

    return run
