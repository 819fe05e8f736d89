"""What a task of Python holds is bounded by bytes, not by the rows of a batch."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest
from tessera.functions import batches
from tessera.functions import text as T
from tessera.operators import language, patterns, ranking, split
from tessera.sources import pages, plain

SIZES = [3, 0, 4, 4, 30, 2, None, 9, 1]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(batches, "MOST_BYTES", 10)


def test_pieces_hold_all_rows_in_order(small):
    texts = [None if n is None else "x" * n for n in SIZES]
    got = list(batches.pieces(iter([pa.RecordBatch.from_pydict({"k": range(len(texts)), "t": texts})] * 2), 1))
    assert sum((b.column(1).to_pylist() for b in got), []) == texts * 2
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 10 for b in got)


@pytest.mark.parametrize("f", [T.cleaned, pages.faithful, plain.text_units])
def test_pandas_functions_give_back_bounded_pieces(small, f):
    given = pd.Series(["abcdef"] * 5)
    got = list(f.func(iter([given])))
    assert [len(c) for c in got] == [1] * 5


def test_operators_read_pieces():
    for module in (language, patterns, ranking):
        assert module.pieces is batches.pieces
    assert split.pieces_of is batches.pieces
