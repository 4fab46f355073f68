"""Ranges of lines and sentences inside a row, in one pass over the row's numbers.

A fold in a column expression copies its result at every step; these kernels get the numbers of a
batch of rows as Arrow lists and give back ranges, in time proportional to the numbers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_RANGES = "array<struct<a: int, b: int>>"
# Level of a line that is no heading.
NO_LEVEL = -(1 << 31)
BLOCK_RANGES = "array<struct<section: int, subsection: int, a: int, b: int>>"


def _rows(lists: pa.ListArray):
    """The numbers of each row; a null list is empty."""
    values = lists.values.fill_null(0).to_numpy()
    offsets = lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    for a, b, ok in zip(offsets, offsets[1:], valid):
        yield values[a:b] if ok else values[:0]


def _lists(found: list[list[tuple]], names: tuple[str, ...]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    columns = list(zip(*(r for rows in found for r in rows))) or [()] * len(names)
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], list(names))
    return pa.ListArray.from_arrays(offsets, structs)


def cut_chunks(counts: np.ndarray, max_words: int, overlap: int) -> list[tuple[int, int]]:
    """First and last sentence of each chunk: as many as fit, at least one new one, ``overlap`` repeated."""
    n, out, first, least = len(counts), [], 0, 1
    if not n:
        return out
    upto = np.cumsum(counts, dtype=np.int64)
    while True:
        before = int(upto[first - 1]) if first else 0
        end = max(least, int(np.searchsorted(upto, before + max_words, side="right")))
        if end >= n:
            return [*out, (first, n - 1)]
        out.append((first, end - 1))
        first, least = max(first, end - overlap), end + 1


def cut_blocks(levels: np.ndarray) -> list[tuple]:
    """``(section, subsection, first, last)`` line numbers of each block, from heading levels."""
    out: list[tuple] = []
    section = subsection = None
    first, at = -1, 0
    heads = np.flatnonzero(levels != NO_LEVEL)
    for head in [*heads.tolist(), len(levels)]:
        if head > at and first < 0:
            first = at
        if first >= 0:
            out.append((section, subsection, first, head - 1))
        if head == len(levels):
            break
        level = levels[head]
        if level == 1:
            section, subsection = head, None
        elif level == 2:
            subsection = head
        first = -1 if level in (1, 2) else head
        at = head + 1
    return out


def chunk_ranges_of(counts: Column, max_words: int, overlap: int) -> Column:
    @F.arrow_udf(CHUNK_RANGES)
    def run(lists: pa.Array) -> pa.Array:
        return _lists([cut_chunks(c, max_words, overlap) for c in _rows(lists)], ("a", "b"))

    return run(counts)


def block_ranges_of(levels: Column) -> Column:
    @F.arrow_udf(BLOCK_RANGES)
    def run(lists: pa.Array) -> pa.Array:
        return _lists([cut_blocks(v) for v in _rows(lists)], ("section", "subsection", "a", "b"))

    return run(F.transform(levels, lambda v: F.coalesce(v, F.lit(NO_LEVEL))))
