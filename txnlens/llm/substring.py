"""Removal of word runs that an earlier document holds, found level by level.

Windows of ``window`` words are looked for in two levels, each twice as long as the one before (the
last is cut to the window): runs of half the length are compared first, and only those that occur
in two documents are extended to the whole window and compared again. Of the half runs in a window
one, its anchor, is enough: equal windows have equal anchors. A longer ``window`` has more levels.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnlens.llm import kernels as K
from txnlens.llm import repeats as R

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
SCHEMA = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
# Bytes of text worked on at a time.
BATCH = 1 << 19
# Levels shorter than this would name nearly every place.
SHORTEST = 7


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Run lengths from short to long, the last one the window: each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        half = (out[0] + 1) // 2
        if half < shortest:
            break
        out.insert(0, half)
    return out


def _rows(chunk: R.Chunk, replies: dict) -> np.ndarray:
    return np.flatnonzero(chunk.has_id & ~R.copies(chunk, replies))


def _candidates(chunk: R.Chunk, replies: dict, window: int, lengths: list[int], known: int, n: int):
    """For batches of rows: rows, words, and the starts of windows whose runs at the first ``known`` lengths all
    occur in two documents."""
    rows = _rows(chunk, replies)
    whole = chunk.take(rows)
    for a, b in K.batches(whole, BATCH):
        part = K.Texts(whole.data[whole.offsets[a] : whole.offsets[b]], whole.offsets[a : b + 1] - whole.offsets[a])
        words = K.words(part)
        alive, anchor = None, []
        for length in lengths:
            ok, place, key = K.anchors(words.hash, words.offsets, window, length)
            alive = ok if alive is None else alive
            anchor.append((place, key))
        if alive is None:
            alive = K.inside(words.offsets, window, max(0, len(words.hash) - window + 1))
        for level in range(known):
            start = np.flatnonzero(alive)
            place, key = anchor[level]
            alive[start] = R.is_seen(replies, level + 1, key[start], n)
        yield rows[a:b], words, np.flatnonzero(alive), anchor


def _seek(window: int, lengths: list[int], level: int, n: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        found_rows, found_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for rows, words, start, anchor in _candidates(chunk, replies, window, lengths[: level + 1], level, n):
            place, key = anchor[level]
            once = np.unique(place[start], return_index=True)[1]
            found_rows.append(rows[words.row[place[start[once]]]])
            found_keys.append(key[start[once]])
        return R.parts_table(R.seen_parts(chunk.number, np.concatenate(found_rows), np.concatenate(found_keys), n))

    return run


def _whole(words: K.Words, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hash of the windows."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return K.window_hashes(words.hash, window)[start], (K.window_hashes(words.hash, window, 1)[start] >> np.uint64(32)).astype(np.uint32)


def _extend(window: int, lengths: list[int], n: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        ids, keys, checks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for rows, words, start, _ in _candidates(chunk, replies, window, lengths, len(lengths), n):
            key, check = _whole(words, start, window)
            ids.append(chunk.ids[rows[words.row[start]]])
            keys.append(key)
            checks.append(check)
        return R.parts_table(R.first_parts(chunk.number, np.concatenate(ids), np.concatenate(keys), np.concatenate(checks), n))

    return run


def _remove(window: int, lengths: list[int], n: int):
    last = len(lengths) + 1

    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        copy = R.copies(chunk, replies)
        found = []
        for rows, words, start, _ in _candidates(chunk, replies, window, lengths, len(lengths), n):
            key, check = _whole(words, start, window)
            row = words.row[start]
            first = start - words.offsets[row]
            found.append((rows[row], first, chunk.ids[rows[row]], key, check))
        row, first, ids, key, check = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
        if len(row):
            later = R.is_later(replies, last, ids, key, check)
            row, first = row[later], first[later]
        cuts = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
        out = []
        for i in range(len(chunk.ids)):
            words = chunk.texts.row(i).split()
            total = len(words)
            if copy[i] and total >= window:
                words = []
            elif cuts[i + 1] > cuts[i]:
                step = np.zeros(total + 1, np.int64)
                mine = first[cuts[i] : cuts[i + 1]]
                np.add.at(step, mine, 1)
                np.add.at(step, mine + window, -1)
                words = list(compress(words, np.cumsum(step[:-1]) == 0))
            kept = b" ".join(words)
            out.append((int(chunk.ids[i]) if chunk.has_id[i] else None, total, total - len(words), kept.decode("utf-8"), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return run


def remove_repeated_runs(docs: DataFrame, window: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256)``: every word covered by a run of ``window`` words that also
    starts in a document with a smaller ``doc_id`` is removed.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; the kept ones are joined by one space.
    Runs are judged on the texts as given. Null texts are empty. Rows with equal ``doc_id`` are one
    document to each other: neither is earlier. Rows with a null id come last, are kept whole, and
    have no part in the search. Other columns are not looked at. Each row gives one row.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    n, lengths = R.buckets(docs), levels(window)[:-1]
    chunks = R.in_chunks(docs)
    replies = R.copy_replies(chunks)
    for level in range(len(lengths)):
        parts = R.per_chunk(chunks, replies, _seek(window, lengths, level, n), R.PARTS)
        replies = replies.unionByName(R.seen_replies(parts, level + 1))
    parts = R.per_chunk(chunks, replies, _extend(window, lengths, n), R.PARTS)
    replies = replies.unionByName(R.first_replies(parts, len(lengths) + 1))
    return R.per_chunk(chunks, replies, _remove(window, lengths, n), SCHEMA)
