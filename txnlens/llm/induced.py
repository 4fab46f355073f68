"""Suffixes of many short texts in order, with common prefixes, by external induced sorting.

The leftmost S-suffixes (LMS) are put in order first; from them all L-suffixes follow in one scan
upwards over the symbols, and from those all S-suffixes in one scan downwards. A scanned suffix puts
the suffix one place before it into the queue of that one's first symbol, with the length of the
prefix it shares with the one queued there before: one more than the least that was passed on the
way. Queues hand out suffixes in the order they were put in, a whole symbol at a time, and lie on
disk once they are more than a given number of bytes.

The order of the LMS-suffixes comes from the same scans over unsorted ones, which orders the pieces
between them; the string of the pieces' names is then sorted by doubling, since no common prefix
beyond the length asked for matters. That bounds the recursion.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from txnlens.llm.kernels import mix

# Symbols: 0 ends all, 1 ends a text, bytes follow.
END, SEPARATOR, SHIFT = 0, 1, 2
SYMBOLS = 256 + SHIFT
# Bytes that queues hold in memory before they go to disk.
QUEUE_BYTES = 64 << 20


class Queues:
    """First-in-first-out queues of (place, common prefix), one for each symbol."""

    def __init__(self, folder: str, limit: int = QUEUE_BYTES):
        self.folder, self.limit, self.held = folder, limit, 0
        self.memory: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.on_disk: set[int] = set()

    def put(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        self.memory.setdefault(symbol, []).append((place, common))
        self.held += place.nbytes + common.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in self.memory.items():
            for suffix, k in (("place", 0), ("common", 1)):
                with open(os.path.join(self.folder, f"{symbol}.{suffix}"), "ab") as file:
                    for part in parts:
                        file.write(part[k].tobytes())
            self.on_disk.add(symbol)
        self.memory, self.held = {}, 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        if symbol in self.on_disk:
            self.on_disk.discard(symbol)
            read = []
            for suffix, kind in (("place", np.int32), ("common", np.uint8)):
                name = os.path.join(self.folder, f"{symbol}.{suffix}")
                read.append(np.fromfile(name, kind))
                os.unlink(name)
            parts.append(tuple(read))
        for part in self.memory.pop(symbol, []):
            parts.append(part)
            self.held -= part[0].nbytes + part[1].nbytes
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def __contains__(self, symbol: int) -> bool:
        return symbol in self.memory or symbol in self.on_disk


class Scan:
    """One pass of induction: what is scanned is queued one place earlier where ``wanted`` says so."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.seen: set[int] = set()
        # Least common prefix passed since a symbol was last queued; nothing was queued yet.
        self.low = np.zeros(SYMBOLS, np.uint8)

    def __call__(self, place: np.ndarray, common: np.ndarray) -> None:
        """Scan suffixes; ``common`` is what each shares with the one scanned before it."""
        if not len(place):
            return
        before = place - 1
        at = np.flatnonzero((place > 0) & self.wanted[before])
        if not self.cap:  # the order alone is asked for
            self._queue(before, at)
            return
        rest = np.minimum.accumulate(common[::-1])[::-1]
        if not len(at):
            np.minimum(self.low, rest[0], out=self.low)
            return
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.append(True, symbol[1:] != symbol[:-1])
        since = np.append(-1, at[:-1]) + 1
        since[first] = 0
        least = _range_min(common, since, at)
        least[first] = np.minimum(least[first], self.low[symbol[first]])
        shared = np.minimum(least.astype(np.int16) + 1, self.cap).astype(np.uint8)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(at))
        np.minimum(self.low, rest[0], out=self.low)
        for a, b in zip(starts.tolist(), ends.tolist()):
            s = int(symbol[a])
            part = shared[a:b]
            if s not in self.seen:
                self.seen.add(s)
                part[0] = 0
            last = int(at[b - 1])
            self.low[s] = rest[last + 1] if last + 1 < len(rest) else self.cap
            self.queues.put(s, before[at[a:b]], part)

    def _queue(self, before: np.ndarray, at: np.ndarray) -> None:
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        symbol, place = symbol[order], before[at[order]]
        starts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else at
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(symbol)).tolist()):
            self.queues.put(int(symbol[a]), place[a:b], np.zeros(b - a, np.uint8))


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` for each pair."""
    span = last - first + 1
    level = np.zeros(len(span), np.int64)
    out = np.empty(len(span), values.dtype)
    level = np.int64(np.floor(np.log2(span)))
    table, length = values, 1
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - length + 1])
        if k < level.max():
            table = np.minimum(table[:-length], table[length:])
            length *= 2
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them (S)."""
    step = np.append(np.sign(text[1:].astype(np.int32) - text[:-1]), 1)
    index = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    return step[np.minimum.accumulate(index[::-1])[::-1]] > 0


def _run_lengths(text: np.ndarray) -> np.ndarray:
    """How often the first symbol of each suffix is repeated at its start, at most 255."""
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, np.arange(len(text)), len(text) - 1)
    return np.minimum(np.minimum.accumulate(end[::-1])[::-1] - np.arange(len(text)) + 1, 255).astype(np.uint8)


def _induce(text: np.ndarray, is_s: np.ndarray, runs: np.ndarray, seeds: np.ndarray, common: np.ndarray, cap: int, limit: int):
    """All suffixes but the last, from LMS-suffixes in order: ``(place, common prefix with the one before)``."""
    with tempfile.TemporaryDirectory() as folder:
        queues = Queues(folder, limit)
        scan = Scan(text, ~is_s, queues, cap)
        cuts = np.searchsorted(text[seeds], np.arange(SYMBOLS + 1))
        upper: list = [None] * SYMBOLS
        for c in range(SYMBOLS):
            found = []
            while c in queues:
                part = queues.take(c)
                found.append(part)
                scan(*part)
            place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int32)
            upper[c] = place, np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint8)
            a, b = cuts[c], cuts[c + 1]
            if b > a:
                mine = common[a:b].copy()
                mine[0] = min(runs[place[-1]], runs[seeds[a]], cap) if len(place) else 0
                scan(seeds[a:b], mine)
        scan = Scan(text, is_s, queues, cap)
        lower: list = [None] * SYMBOLS
        for c in range(SYMBOLS - 1, -1, -1):
            found = []
            while c in queues:
                part = queues.take(c)
                found.append(part)
                scan(*part)
            place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int32)
            lower[c] = place, np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint8)
            up, shared = upper[c]
            if len(up):
                back = np.append(shared[1:], min(runs[up[-1]], runs[place[-1]], cap) if len(place) else 0).astype(np.uint8)[::-1]
                scan(up[::-1], back)
    places, commons = [], []
    for c in range(SYMBOLS):
        up, shared = upper[c]
        down, below = lower[c]
        places += [up, down[::-1]]
        if len(down):
            mine = np.append(min(runs[up[-1]], runs[down[-1]], cap) if len(up) else 0, below[1:][::-1]).astype(np.uint8)
            commons += [shared, mine]
        else:
            commons.append(shared)
    return np.concatenate(places), np.concatenate(commons)


def _common_prefix(text: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """What each suffix shares with the one before it in the list, at most ``cap``: by hashes of runs of 1, 2, 4, ...
    symbols, the longest compared first."""
    padded = np.concatenate([text, np.zeros(2 * cap + 2, text.dtype)]).astype(np.uint64) + np.uint64(1)
    runs, length = [mix(padded)], 1
    while length * 2 <= cap:
        now = runs[-1]
        runs.append(mix(now[:-length] * np.uint64(0x9E3779B97F4A7C15) + now[length:]))
        length *= 2
    x, y = places[1:].astype(np.int64), places[:-1].astype(np.int64)
    shared = np.zeros(len(x), np.int64)
    # The longest run is tried twice: twice its length is more than the cap.
    for run, length in zip([runs[-1], *runs[::-1]], [length, *(1 << k for k in range(len(runs) - 1, -1, -1))]):
        shared += length * (run[x + shared] == run[y + shared])
    return np.append(0, np.minimum(shared, cap)).astype(np.uint8)


def _sorted_lms(text: np.ndarray, is_s: np.ndarray, runs: np.ndarray, lms: np.ndarray, cap: int, limit: int) -> np.ndarray:
    """LMS-suffixes in order, as far as ``cap`` symbols tell."""
    seeds = lms[np.argsort(text[lms], kind="stable")]
    order, _ = _induce(text, is_s, runs, seeds, np.zeros(len(seeds), np.uint8), 0, limit)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = np.append(lms[-1], order[is_lms[order]])  # the end of all comes first
    # Pieces reach from one LMS place to the next; equal ones get one name.
    number = np.empty(len(text), np.int32)
    number[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms), 0) + 1
    power = np.full(len(text), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.append(np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9) * power))
    inverse = np.full(len(text), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    piece = (sums[lms + size] - sums[lms]) * inverse[lms]
    n = number[ordered]
    differs = (piece[n][1:] != piece[n][:-1]) | (size[n][1:] != size[n][:-1])
    name = np.empty(len(lms), np.int64)
    name[n] = np.append(0, np.cumsum(differs))
    length = 1
    while length < cap and name.max() < len(lms) - 1:  # a piece has one symbol more than it adds, so two or more each
        after = np.append(name[length:] + 1, np.zeros(min(length, len(name)), np.int64))[: len(name)]
        key = name * (len(lms) + 2) + after
        by = np.argsort(key)
        name[by] = np.append(0, np.cumsum(key[by][1:] != key[by][:-1]))
        length *= 2
    return lms[np.argsort(name)]


def sort_suffixes(data: np.ndarray, sizes: np.ndarray, cap: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the texts ``data`` cut into ``sizes``, in order as far as ``cap`` symbols tell.

    Returns where each text starts in the joined text, the places of all suffixes in order, and the
    symbols each shares with the one before it, at most ``cap``. Separators count as symbols.
    """
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.full(int(sizes.sum()) + len(sizes) + 1, SEPARATOR, np.uint16)
    text[-1] = END
    target = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    text[target] = data.astype(np.uint16) + SHIFT
    is_s = _types(text)
    runs = _run_lengths(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    ordered = _sorted_lms(text, is_s, runs, lms, cap, limit)
    places, common = _induce(text, is_s, runs, ordered, _common_prefix(text, ordered, cap), cap, limit)
    return starts, places, common
