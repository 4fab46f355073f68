"""Hashing of words and windows over whole Arrow text columns at once.

All hashes are 64 bit and a function of the content alone, so they agree between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomial hashes and of the finaliser.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
# Bytes hashed at a time: the working arrays, some 60 times that, stay in the caches.
BLOCK_BYTES = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers in which every input bit reaches every output bit."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _MIX_1
    out ^= out >> np.uint64(27)
    out *= _MIX_2
    out ^= out >> np.uint64(31)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """1, ``base``, its square and so on, ``n`` numbers."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Texts:
    """Bytes of a column of texts; row ``i`` is ``data[offsets[i]:offsets[i + 1]]``, null is empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def batches(t: Texts, limit: int):
    """Ranges of whole rows of at most ``limit`` bytes each; a longer row stands alone."""
    first = 0
    while first < len(t):
        last = int(np.searchsorted(t.offsets, t.offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(t))
        yield first, last
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


@dataclass
class Words:
    """Words of many texts in order; those of row ``i`` are ``offsets[i]:offsets[i + 1]``."""

    start: np.ndarray  # first byte in the data
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words(t: Texts, fold_case: bool = False) -> Words:
    """Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; they end with their text."""
    edge = np.zeros(len(t.data) + 1, dtype=bool)
    edge[t.offsets] = True
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(t.data):
        stop = min(at + BLOCK_BYTES, len(t.data))
        while stop < len(t.data):  # the block ends where a word does
            later = t.data[stop - 1 : stop + BLOCK_BYTES]
            cut = np.flatnonzero(_is_space(later) | edge[stop - 1 : stop - 1 + len(later)])
            cut = cut[cut > 0]
            if len(cut):
                stop = stop - 1 + int(cut[0])
                break
            stop = min(stop + BLOCK_BYTES, len(t.data))
        data = t.data[at:stop]
        space = _is_space(data)
        begins = ~space
        begins[1:] &= space[:-1] | edge[at + 1 : stop]
        start = np.flatnonzero(begins)
        finishes = ~space
        finishes[:-1] &= space[1:] | edge[at + 1 : stop]
        end = np.flatnonzero(finishes) + 1
        if len(start):
            plain = lower(data) if fold_case else data
            longest = int((end - start).max())
            # Each byte is weighed by its place in its word, so the sums need no division.
            place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
            if place is None:
                place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
            power = powers(_BYTE_BASE, longest)
            value = np.where(space, np.uint64(0), power[np.minimum(place, longest - 1)] * (plain.astype(np.uint64) + np.uint64(1)))
            hashes.append(mix(np.add.reduceat(value, start) ^ (end - start).astype(np.uint64)))
            starts.append(start + at)
            ends.append(end + at)
        at = stop
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    found = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    return Words(start, end, found, np.searchsorted(start, t.offsets))


def window_hashes(items: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` items (also those across rows); empty if there are too few."""
    if len(items) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(items) - size + 1, np.uint64)
    base = np.uint64((_WORD_BASE + 2 * salt) & 0xFFFFFFFFFFFFFFFF)
    if size <= 16:
        for j in range(size):
            out *= base
            out += items[j : j + len(out)]
        return mix(out)
    # Long runs by doubling: a run of 2n items is two runs of n.
    whole, length, at, run = None, 1, 0, items
    factor = int(base)
    while True:
        if size & length:
            part = run[at : at + len(out)]
            whole = part.copy() if whole is None else whole + part * np.uint64(pow(int(base), at, 1 << 64))
            at += length
        if at == size:
            return mix(whole)
        run = run[: len(run) - length] + run[length:] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
        length *= 2


def inside(offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first ``n`` starts have a whole window of ``size`` items in their row."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n) + size <= end[:n]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    length = 1
    while length * 2 <= size:
        values = np.minimum(values[: len(values) - length], values[length:])
        length *= 2
    rest = size - length
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _next_equal(hashes: np.ndarray, least: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For every start the first of ``size`` places at or after it whose hash is the least one."""
    out = np.full(len(starts), -1, np.int64)
    todo = np.arange(len(starts))
    for shift in range(size):
        if not len(todo):
            break
        at = starts[todo]
        hit = hashes[at + shift] == least[at]
        out[todo[hit]] = at[hit] + shift
        todo = todo[~hit]
    return out


def anchors(items: np.ndarray, offsets: np.ndarray, window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a window of ``window`` items: is it one, and the place and hash of its anchor.

    The anchor is the run of ``part`` items inside the window with the least hash, the first such run
    on ties. Equal windows have equal anchors at equal places, so a window occurs twice only if its
    anchor does; neighbouring windows mostly share theirs.
    """
    n = len(items) - window + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = window_hashes(items, part)
    least = sliding_min(hashes, window - part + 1)
    # Where the minimum stands: looked for where it changes, and carried on while it is inside. A lower one has
    # just come in at the end.
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    found = starts + (window - part)
    higher = np.flatnonzero(np.append(True, least[starts[1:]] > least[starts[:-1]]))
    found[higher] = _next_equal(hashes, least, starts[higher], window - part + 1)
    place = np.repeat(found, np.diff(np.append(starts, n)))
    gone = np.flatnonzero(place < np.arange(n))  # ties: the next of several equal runs takes over
    place[gone] = _next_equal(hashes, least, gone, window - part + 1)
    # Least hashes crowd at the low end; mixed again they deal evenly.
    return inside(offsets, window, n), place, np.repeat(mix(least[starts]), np.diff(np.append(starts, n)))
