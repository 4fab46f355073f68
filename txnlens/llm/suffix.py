"""Byte runs that an earlier document holds, by suffix arrays with common prefixes.

Equal strings of ``length`` bytes have equal anchors (see ``kernels.anchors``), so only strings whose
anchor occurs in two documents can be repeated. Their surroundings are cut out and dealt into shards
by the anchor: equal strings meet in one shard. A shard sorts its suffixes by external induced
sorting; neighbours that share ``length`` bytes are one string, and its smallest document is known.
The shard answers with one bit for each string. A piece that a chunk holds many times is sent once,
so a passage in a third of all documents is not gathered document by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnlens.llm import kernels as K
from txnlens.llm import repeats as R
from txnlens.llm.induced import sort_suffixes

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])
# Bytes of text worked on at a time, and bytes of pieces sorted together; queues go to disk beyond a part of that.
BATCH = 1 << 17
SORTED = 1 << 20
# Pieces whose bits are set at a time.
LOT = 1 << 12
SEEN, STRINGS = 1, 2


def anchor_length(length: int) -> int:
    return (length + 1) // 2


def _rows(chunk: R.Chunk, replies: dict) -> np.ndarray:
    return np.flatnonzero(chunk.has_id & ~R.copies(chunk, replies))


def _strings(chunk: R.Chunk, rows: np.ndarray, length: int):
    """For batches of rows: rows, bytes, the starts of strings, and the place and hash of their anchors."""
    whole = chunk.take(rows)
    for a, b in K.batches(whole, BATCH):
        data, offsets = whole.data[whole.offsets[a] : whole.offsets[b]], whole.offsets[a : b + 1] - whole.offsets[a]
        ok, place, key = K.anchors(data.astype(np.uint64), offsets, length, anchor_length(length))
        start = np.flatnonzero(ok)
        yield rows[a:b], data, offsets, start, place[start], key[start]


def _seek(length: int, n: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        of, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for rows, data, offsets, start, place, key in _strings(chunk, _rows(chunk, replies), length):
            new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
            of.append(rows[np.searchsorted(offsets, place[new], side="right") - 1])
            keys.append(key[new])
        return R.parts_table(R.seen_parts(chunk.number, np.concatenate(of), np.concatenate(keys), n))

    return run


class Pieces:
    """Pieces of a chunk around repeated anchors: a run of strings that start one after the other.

    ``row``, ``first`` (byte in the text), ``count`` (strings); ``which`` numbers equal pieces alike,
    in the order in which they are sent; ``low`` is the smallest document of each number. That order follows
    from the contents alone: the rows of a chunk may come in another order each time they are fetched, and
    the bits that come back are for the pieces in the order in which they were sent.
    """

    def __init__(self, chunk: R.Chunk, replies: dict, length: int, n: int, bodies: bool):
        row, first, count, keys, one, two, body = [], [], [], [], [], [], []
        for rows, data, offsets, start, place, key in _strings(chunk, _rows(chunk, replies), length):
            if not len(start):
                continue
            # Strings in a row mostly share their anchor, which is looked up once.
            new = np.append(True, place[1:] != place[:-1])
            alive = R.is_seen(replies, SEEN, key[new], n)[np.cumsum(new) - 1]
            start, place, key = start[alive], place[alive], key[alive]
            if not len(start):
                continue
            head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
            size = np.diff(np.append(head, len(start)))
            begin = start[head]
            local = np.searchsorted(offsets, begin, side="right") - 1
            row.append(rows[local])
            first.append(begin - offsets[local])
            count.append(size)
            keys.append(key[head])
            h1, h2 = _spans(data, begin, begin + size + length - 1)
            one.append(h1)
            two.append(h2)
            if bodies:
                body.append(data[np.repeat(begin, size + length - 1) + _within(size + length - 1)])
        none = np.zeros(0, np.int64)
        join = lambda x, kind=np.int64: np.concatenate([none.astype(kind), *x])
        self.row, self.first, self.count = join(row), join(first), join(count)
        size = self.count + length - 1
        keys, one, two = join(keys, np.uint64), join(one, np.uint64), join(two, np.uint64)
        ids = chunk.ids[self.row]
        bucket = R.bucket_of(keys, n).astype(np.int64)
        order = np.lexsort((ids, self.count, two, one, bucket))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for value in (bucket, one, two, self.count):
            new[1:] |= value[order][1:] != value[order][:-1]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        sent = order[new]
        self.low, self.bucket, self.sent_count, self.key = ids[sent], bucket[sent], self.count[sent], keys[sent]
        self.sent_size = size[sent]
        if bodies:
            begins = np.cumsum(size) - size
            self.sent = join(body, np.uint8)[np.repeat(begins[sent], size[sent]) + _within(size[sent])]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of some ranges."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _weights(base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the 256 bytes, powers of the base, and what these are divided by."""
    byte = K.mix(np.arange(256, dtype=np.uint64) + np.uint64(base & 0xFF))
    return byte, K.powers(base, n), K.powers(pow(base, -1, 1 << 64), n)


# Weights of batches of the usual size, by base and size; worked out once a task.
_KEPT: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of parts of the data, which depend on the bytes of each part alone."""
    out, n = [], len(data)
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        if n < 2 * BATCH:
            if (base, BATCH) not in _KEPT:
                _KEPT[base, BATCH] = _weights(base, 2 * BATCH)
            byte, power, inverse = _KEPT[base, BATCH]
        else:
            byte, power, inverse = _weights(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[data] * power[:n], out=sums[1:])
        # Divided by the power at which the part begins: wherever it stands, it has one hash.
        out.append(K.mix((sums[end] - sums[begin]) * inverse[begin]))
    return out[0], out[1]


def _hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of pieces that follow each other, worked out in lots."""
    one, two, first = [], [], 0
    while first < len(begins):
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + BATCH)))
        stop = int(begins[last - 1] + sizes[last - 1])
        h1, h2 = _spans(data[begins[first] : stop], begins[first:last] - begins[first], begins[first:last] + sizes[first:last] - begins[first])
        one.append(h1)
        two.append(h2)
        first = last
    return np.concatenate(one), np.concatenate(two)


def _send(length: int, n: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        p = Pieces(chunk, replies, length, n, bodies=True)
        cuts = np.flatnonzero(np.append(True, p.bucket[1:] != p.bucket[:-1])) if len(p.bucket) else np.zeros(0, np.int64)
        ends = np.cumsum(p.sent_size)
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(p.bucket))):
            lo, hi = int(ends[a] - p.sent_size[a]), int(ends[b - 1])
            about = np.concatenate([p.sent_size[a:b].view(np.uint64), p.key[a:b]])
            rows.append({"bucket": int(p.bucket[a]), "chunk": chunk.number, "keys": about.tobytes(), "extra": p.sent[lo:hi].tobytes(), "first": p.low[a:b].tobytes()})
        return R.parts_table(rows)

    return run


def _later(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every byte of the pieces: does a string start here that a smaller document has?"""
    starts, places, common = sort_suffixes(data, sizes, length)
    piece = np.repeat(np.arange(len(sizes)), sizes + 1)[places]  # a separator follows each piece
    inside = places - starts[piece]
    whole = inside + length <= sizes[piece]
    group = np.cumsum(common < length)
    group, piece, inside = group[whole], piece[whole], inside[whole]
    out = np.zeros(len(data), bool)
    if len(group):
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(ids[piece], head)
        late = ids[piece] > np.repeat(least, np.diff(np.append(head, len(group))))
        begins = np.cumsum(sizes) - sizes
        out[begins[piece[late]] + inside[late]] = True
    return out


def _sort(length: int):
    def run(table: pa.Table) -> pa.Table:
        about = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("keys").to_pylist()]
        sizes = np.concatenate([x[0] for x in about]).astype(np.int64)
        keys = np.concatenate([x[1] for x in about])
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("extra").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("first").to_pylist()])
        begins = np.cumsum(sizes) - sizes
        # Pieces that many chunks have sent are sorted once, for their smallest document.
        one, two = _hashes(data, begins, sizes)
        order = np.lexsort((ids, sizes, two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (sizes[order][1:] != sizes[order][:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        sole = order[new]
        bits = np.zeros(len(data), bool)
        # Pieces with one anchor stay together; anchors are sorted in several lots.
        _, place = np.unique(keys[sole], return_inverse=True)
        total = np.bincount(place, sizes[sole]).astype(np.int64)
        alone = np.bincount(place) < 2
        lot = np.cumsum(np.where(alone, 0, total)) // SORTED
        lot[alone] = -1
        of = lot[place]
        by_lot = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.append(True, of[by_lot][1:] != of[by_lot][:-1]))
        for first, last in zip(cuts, np.append(cuts[1:], len(by_lot))):
            if of[by_lot[first]] >= 0:
                mine = sole[by_lot[first:last]]
                at = np.repeat(begins[mine], sizes[mine]) + _within(sizes[mine])
                bits[at] = _later(data[at], sizes[mine], ids[mine], length)
        # The others have the bits of the one that was sorted, or all if its document is smaller.
        others = order[~new]
        for first in range(0, len(others), LOT):
            rest = others[first : first + LOT]
            mine, size = sole[which[rest]], sizes[rest]
            step = _within(size)
            whole = np.repeat(ids[rest] > ids[mine], size) & (step <= np.repeat(size - length, size))
            bits[np.repeat(begins[rest], size) + step] = bits[np.repeat(begins[mine], size) + step] | whole
        rows, a = [], 0
        for chunk, x in zip(table.column("chunk").to_pylist(), about):
            b = a + int(x[0].sum())
            if bits[a:b].any():
                rows.append({"chunk": chunk, "level": STRINGS, "keys": np.array([table.column("bucket")[0].as_py()], np.uint64).tobytes(), "extra": None, "first": np.packbits(bits[a:b]).tobytes()})
            a = b
        return R._pack(rows, R._REPLIES)

    return run


def _remove(length: int, n: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        copy = R.copies(chunk, replies)
        p = Pieces(chunk, replies, length, n, bodies=False)
        ends = np.cumsum(p.sent_size)
        bits = np.zeros(int(p.sent_size.sum()), bool)
        for level, key, flags in zip(*(replies["table"].column(c).to_pylist() for c in ("level", "keys", "first"))):
            if level == STRINGS:
                mine = np.flatnonzero(p.bucket == int(np.frombuffer(key, np.uint64)[0]))
                lo, hi = int(ends[mine[0]] - p.sent_size[mine[0]]), int(ends[mine[-1]])
                bits[lo:hi] = np.unpackbits(np.frombuffer(flags, np.uint8), count=hi - lo)
        # Strings of all pieces: later if their document is not the piece's first, or if the bit says so.
        of = np.repeat(np.arange(len(p.row)), p.count)
        step = _within(p.count)
        begins = ends - p.sent_size
        gone = (chunk.ids[p.row] > p.low[p.which])[of] | bits[begins[p.which[of]] + step]
        start = chunk.texts.offsets[p.row[of]] + p.first[of] + step
        start = start[gone]
        depth = np.zeros(len(chunk.texts.data) + 1, np.int32)
        depth[start] += 1  # a string is in one piece, so no start comes twice
        depth[start + length] -= 1
        removed = np.cumsum(depth[:-1]) > 0
        offsets = chunk.texts.offsets
        out = []
        for i in range(len(chunk.ids)):
            mine = removed[offsets[i] : offsets[i + 1]]
            text = chunk.texts.data[offsets[i] : offsets[i + 1]]
            if copy[i] and len(text) >= length:
                mine = np.ones(len(text), bool)
            kept = text[~mine].tobytes()
            spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum())
            out.append((int(chunk.ids[i]) if chunk.has_id[i] else None, len(text), len(text) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)``: every byte covered by a string of ``length`` bytes
    that also starts in a document with a smaller ``doc_id`` is removed.

    Texts are UTF-8 bytes, null is empty; strings are judged on the texts as given and end with
    their text. ``kept`` is what is left, ``n_spans`` the number of maximal runs removed. Rows with
    equal ``doc_id`` are one document to each other: neither is earlier. Rows with a null id come
    last, are kept whole, and have no part in the search. Other columns are not looked at. Each row
    gives one row.
    """
    if not 4 <= length <= 250:
        raise ValueError("length must be from 4 to 250 bytes")
    n = R.buckets(docs)
    chunks = R.in_chunks(docs)
    replies = R.copy_replies(chunks)
    parts = R.per_chunk(chunks, replies, _seek(length, n), R.PARTS)
    replies = replies.unionByName(R.seen_replies(parts, SEEN))
    pieces = R.per_chunk(chunks, replies, _send(length, n), R.PARTS)
    strings = pieces.groupBy("bucket").applyInArrow(_sort(length), R.REPLIES)
    return R.per_chunk(chunks, replies.unionByName(strings), _remove(length, n), SCHEMA)
