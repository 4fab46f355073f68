"""Benchmark items inside documents, also edited ones, by the character runs they share.

An edit breaks at most as many runs as a run is long, so an edited copy keeps a number of the item's
runs within its length, at any place of a text. Windows of a text with so many runs of any items are
looked at first; in those that are left the runs are told apart by item, and places with as many of
one item are verified by the exact edit distance. Both bounds are exact: no copy is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Length of the character runs that are counted, in bytes; shorter items are looked for as whole words. Runs
# are shorter for items with so many edits that none of this length need be left.
RUN = 9
LEAST_RUN = 3
# Items of one length range share windows; lengths in a range differ by at most this factor.
RANGE = 1.15
# Bytes of items that are looked for together: more of them would make the run count useless.
BLOCK = 1 << 17
# Bytes of items broadcast at a time; a longer benchmark takes more passes over the documents.
BROADCAST = 8 << 20
# Bytes of documents and number of runs of items in them worked on at a time.
PIECE = 1 << 20
SHARED = 1 << 21

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32())])


def normal(text: str | None) -> bytes:
    """A-Z in lower case, white space (0x20, 0x09-0x0D) as one blank."""
    return b" ".join((text or "").encode().translate(_LOWER).split())


def distance_within(item: bytes, text: bytes, most: int) -> int | None:
    """Least edit distance of ``item`` to any part of ``text``, if at most ``most`` (bit-parallel columns)."""
    if item in text:
        return 0
    m, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(d | up) & full, up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        best = min(best, score)
    return best if best <= most else None


def _runs(data: np.ndarray, run: int = RUN) -> np.ndarray:
    """22-bit hash of every run of ``run`` bytes, at most nine."""
    x = np.append(data, np.zeros(max(0, RUN - 1 - run), np.uint8)).astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[: len(x) - shift] | (x[shift:] << np.uint64(8 * shift))
    if run == RUN:
        x = x[: len(x) - 1] * np.uint64(0x9E3779B97F4A7C15) ^ data[8:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    else:
        x = (x & np.uint64((1 << 8 * run) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(42)).astype(np.int64)


def run_length(length: int, edits: int) -> int:
    """Bytes of the runs an item is found by: one at least is left by so many edits."""
    return min(RUN, length // (edits + 1))


class Block:
    """What the tasks need of some items. All copies are found, whatever ``recall`` is asked for."""

    def __init__(self, ids: list, items: list[bytes], share: float, recall: float = 1.0):
        self.ids, self.items, self.share = ids, items, share
        self.run = run = min(run_length(len(item), self.edits(len(item))) for item in items)
        runs = [np.unique(_runs(np.frombuffer(item, np.uint8), run)) for item in items]
        of = np.repeat(np.arange(len(items)), [len(r) for r in runs])
        runs = np.concatenate(runs)
        order = np.argsort(runs, kind="stable")
        self.runs, self.of = runs[order], of[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[runs] = True
        size = np.array([len(i) for i in items])
        # Runs an edited copy shares at least, and bytes it may take.
        self.least = np.array([int(n) - run + 1 - run * self.edits(int(n)) for n in size])
        self.span = np.array([int(n) + self.edits(int(n)) for n in size])
        # Of items of about the same length: fewest runs and most bytes.
        self.ranges, order, first = [], np.argsort(size, kind="stable"), 0
        while first < len(order):
            last = int(np.searchsorted(size[order], size[order[first]] * RANGE, side="right"))
            self.ranges.append((int(self.least[order[first:last]].min()), int(self.span[order[first:last]].max())))
            first = last

    def edits(self, length: int) -> int:
        return int(self.share * length)

    def shared(self, runs: np.ndarray) -> np.ndarray:
        """Places of items' runs in windows that hold enough of them for some range."""
        known = self.seen[runs]
        sums = np.cumsum(np.append(0, known).astype(np.int32), dtype=np.int32)
        inside = np.zeros(len(runs) + 1, np.int32)
        for least, span in self.ranges:
            width = min(span - self.run + 1, len(runs))
            start = np.flatnonzero(sums[width:] - sums[:-width] >= least)
            # Windows that follow each other are one stretch.
            first = np.flatnonzero(np.diff(start, prepend=-2) > 1)
            last = np.append(first[1:], len(start))[: len(first)] - 1
            inside[start[first]] += 1  # stretches do not begin or end at one place twice
            inside[start[last] + width] -= 1
        return np.flatnonzero(known & (np.cumsum(inside[:-1]) > 0))

    def candidates(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item)`` from where on an item's length holds as many of its runs as an edited copy must."""
        places = self.shared(runs)
        low, high = (np.searchsorted(self.runs, runs[places], side) for side in ("left", "right"))
        n, reach = high - low, int(self.span.max())
        upto = np.cumsum(n)
        found, first = [np.zeros((2, 0), np.int64)], 0
        while first < len(places):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + SHARED, side="right")))
            end = int(np.searchsorted(places, places[last - 1] + reach, side="right"))
            k = n[first:end]
            item = self.of[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[first:end], k)]
            place = np.repeat(places[first:end], k)
            by = np.argsort(item, kind="stable")
            item, place = item[by], place[by]
            then = np.arange(len(item)) + self.least[item] - 1
            inside = then < len(item)
            then[~inside] = 0
            good = inside & (item[then] == item) & (place[then] - place <= self.span[item] - self.run)
            found.append(np.stack([item[good], place[good]]))
            first = last
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[1], pairs[0]

    def matches(self, texts: list[bytes]) -> list[tuple[int, object, int]]:
        """``(text, item id, distance)``, the least distance of each pair."""
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined = b"\n".join(texts) + b"\n" + bytes(RUN)
        places, items = self.candidates(_runs(np.frombuffer(joined, np.uint8), self.run))
        rows = np.searchsorted(offsets, places, side="right") - 1
        # Places of an item that are close to each other are verified together.
        new = np.ones(len(places), bool)
        new[1:] = (items[1:] != items[:-1]) | (rows[1:] != rows[:-1]) | (places[1:] - places[:-1] > self.span[items[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places))[: len(first)] - 1
        best: dict[tuple[int, int], int] = {}
        for row, item, low, high in zip(rows[first].tolist(), items[first].tolist(), places[first].tolist(), places[last].tolist()):
            if best.get((row, item)) == 0:
                continue
            text, span = self.items[item], int(self.span[item])
            low, high = max(int(offsets[row]), low - span), min(int(offsets[row + 1]) - 1, high + span)
            found = distance_within(text, joined[low:high], self.edits(len(text)))
            if found is not None:
                best[row, item] = min(found, best.get((row, item), found))
        return [(row, self.ids[item], d) for (row, item), d in best.items()]


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items in groups of ``BROADCAST`` bytes, read from the driver one after the other."""
    group, size = [], 0
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in slim.distinct().orderBy("item_id", "text").toLocalIterator():
        item = normal(row["text"])
        if not item:
            continue
        if group and size + len(item) > BROADCAST:
            yield group
            group, size = [], 0
        group.append((row["item_id"], item))
        size += len(item)
    if group:
        yield group


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.08, recall: float = 0.98) -> DataFrame:
    """``(doc_id, item_id, distance)``: items that a document holds with edits of at most ``share`` of their length.

    Texts and items are compared with A-Z in lower case and white space as one blank, byte by byte.
    All copies are found, exact and edited, wherever they begin, so any ``recall`` asked for is met;
    none is reported that is not within the distance. Each pair is named once, with its least distance. An item
    shorter than nine bytes is found where it stands unchanged between blanks or ends of a text: inside
    words it says nothing. Null and empty texts hold nothing, and null and empty items are nowhere.
    Rows with equal ids are looked at each; other columns are not looked at.
    """
    if not 0 <= share < 1 / LEAST_RUN:
        raise ValueError("so many edits leave only runs that any text has")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    for group in _groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        found = found.unionByName(slim.mapInArrow(_finder(shared, share, recall), "doc_id long, item_id long, distance int"))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _whole_words(texts: list[bytes], short: dict[bytes, list]) -> list[tuple[int, object, int]]:
    """``(text, item id, 0)`` for items of few words that stand as such in a text."""
    sizes = {item.count(b" ") + 1 for item in short}
    found = []
    for row, text in enumerate(texts):
        words = text.split(b" ")
        for n in sizes:
            runs = set(words) if n == 1 else {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
            found += [(row, i, 0) for item in runs & short.keys() for i in short[item]]
    return found


def _finder(shared, share: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short: dict[bytes, list] = {}
        for i, item in shared.value:
            if len(item) < RUN:
                short.setdefault(item, []).append(i)
        blocks, block, size = [], [], 0
        length = lambda item: run_length(len(item), int(share * len(item)))
        for one in sorted((x for x in shared.value if len(x[1]) >= RUN), key=lambda x: (length(x[1]), len(x[1]))):
            if block and (size + len(one[1]) > BLOCK or length(one[1]) != length(block[0][1])):
                blocks.append(Block([i for i, _ in block], [t for _, t in block], share, recall))
                block, size = [], 0
            block.append(one)
            size += len(one[1])
        if block:
            blocks.append(Block([i for i, _ in block], [t for _, t in block], share, recall))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out, piece, rows, size = [], [], [], 0
            for i in range(len(ids)):
                text = normal(texts[i].as_py())
                piece.append(text)
                rows.append(ids[i])
                size += len(text)
                if size >= PIECE or i == len(ids) - 1:
                    for b in blocks:
                        out += [(rows[k], item, d) for k, item, d in b.matches(piece)]
                    if short:
                        out += [(rows[k], item, d) for k, item, d in _whole_words(piece, short)]
                    piece, rows, size = [], [], 0
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.08, recall: float = 0.98, least_bytes: int = RUN) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no item of at least ``least_bytes``; rows with a null id stay.

    See ``find_items``. Shorter items, such as a word, stand in clean documents too; ask for 1 to drop those as well.
    """
    size = F.octet_length(F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " ")))
    hit = find_items(docs, benchmark.filter(size >= least_bytes), share, recall).filter("doc_id is not null").select(F.col("doc_id").alias("hit")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(hit, F.col("id") == F.col("hit"), "left_anti").select("row.*")
