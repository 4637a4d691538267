"""The token diff as a column function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import differ

ENTRIES = T.ArrayType(T.StructType().add("op", T.StringType()).add("value", T.StringType()))
# Fixed value: entries that a worker holds before it gives them out.
MOST_ENTRIES = 100_000


def _entries(ends: list[int], found: list[tuple[str, str]]) -> pa.Array:
    """Lists of (op, value), one up to each end."""
    ops, values = pa.array([op for op, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays([ops, values], ["op", "value"]))


def transcripts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The entries of `compare` for two arrays of tokens, row by row; null arrays are empty. What a worker holds doesn't grow with the rows of a batch."""
    for a, b in batches:
        ends, found = [], []
        for x, y in zip(a, b):
            found += differ.compare(x.as_py() or [], y.as_py() or [])
            ends.append(len(found))
            if len(found) > MOST_ENTRIES:
                yield _entries(ends, found)
                ends, found = [], []
        if ends or not len(a):
            yield _entries(ends, found)


@F.arrow_udf(ENTRIES)
def transcript(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Column function over two arrays of tokens."""
    yield from transcripts(batches)
