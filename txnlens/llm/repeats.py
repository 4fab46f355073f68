"""Which keys of a corpus occur in more than one document, without moving the texts to the keys.

Documents are dealt into chunks of a few MB by a hash of the row. A chunk sends every distinct key
it holds once, packed by key range ("bucket"), and each bucket answers every chunk with those of
its keys that matter there. So a key held by a third of all documents costs one entry per chunk,
and no task ever holds more than a chunk or a bucket. Both grow in number with the shuffle
partitions, which are the caller's measure of the data's size.

``parts`` are rows ``(bucket, chunk, keys, extra, first)`` and ``replies`` are rows
``(chunk, level, keys, extra)``; the binary columns are packed NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.kernels import Texts, texts

PARTS = "bucket int, chunk int, keys binary, extra binary, first binary"
REPLIES = "chunk int, level int, keys binary, extra binary, first binary"
CHUNKS_PER_PARTITION = 2


def in_chunks(docs: DataFrame) -> DataFrame:
    """``(chunk, doc_id, text, h1, h2)``: documents dealt by a hash of the row, and a 128-bit hash of the text."""
    n = CHUNKS_PER_PARTITION * _partitions(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"),
        "doc_id",
        "text",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit("second"), "text").alias("h2"),
    )


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame) -> int:
    """Fewer than partitions: every chunk has a row for every bucket."""
    return (_partitions(df) + 1) // 2


def _pack(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_PARTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary()), ("first", pa.binary())])
_REPLIES = pa.schema([("chunk", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary()), ("first", pa.binary())])


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _split(keys: np.ndarray, n: int):
    """Order by bucket, and ``(bucket, first, last)`` of each."""
    place = bucket_of(keys, n)
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    return order, [(int(place[a]), a, b) for a, b in zip(starts, np.append(starts[1:], len(place)))]


# -- level 1: keys that occur in two documents; may report a few others (32 bits and the bucket are compared)


def seen_parts(chunk: int, row: np.ndarray, keys: np.ndarray, n: int) -> list[dict]:
    """Parts for keys held by rows of this chunk (pairs may repeat)."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys, row = keys[order], row[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, twice = keys[starts], np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts)
    order, groups = _split(keys, n)
    keys, twice = keys[order].astype(np.uint32), twice[order]
    return [
        {"bucket": k, "chunk": chunk, "keys": keys[a:b].tobytes(), "extra": np.packbits(twice[a:b]).tobytes(), "first": None}
        for k, a, b in groups
    ]


def _seen_reply(level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        lists = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(table.column("extra").to_pylist(), lists)]
        all_keys = np.concatenate(lists)
        ordered = np.sort(all_keys)
        repeated = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], all_keys[np.concatenate(flags)]]))
        rows = []
        for chunk, mine in zip(table.column("chunk").to_pylist(), lists):
            hit = np.unique(mine[contains(repeated, mine)])
            if len(hit):
                whole = hit.astype(np.uint64) | np.uint64(bucket << 32)
                rows.append({"chunk": chunk, "level": level, "keys": whole.tobytes(), "extra": None, "first": None})
        return _pack(rows, _REPLIES)

    return run


def seen_replies(parts: DataFrame, level: int) -> DataFrame:
    return parts.groupBy("bucket").applyInArrow(_seen_reply(level), REPLIES)


def contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    place = np.searchsorted(ordered, values)
    place[place == len(ordered)] = 0
    return ordered[place] == values


def is_seen(replies: dict[int, tuple[np.ndarray, np.ndarray]], level: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Which keys of a chunk its level-1 reply names."""
    short = (bucket_of(keys, n) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    return contains(replies[level][0], short)


# -- level 2: keys that also occur in a document with a smaller id; 96 bits are compared


def first_parts(chunk: int, ids: np.ndarray, keys: np.ndarray, check: np.ndarray, n: int) -> list[dict]:
    """Parts with the smallest document of this chunk for each key."""
    order = np.lexsort((ids, check, keys))
    keys, check, ids = keys[order], check[order], ids[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])) if len(keys) else np.zeros(0, bool)
    keys, check, ids = keys[new], check[new], ids[new]
    order = np.argsort(ids, kind="stable")  # ids in order need little space once compressed
    keys, check, ids = keys[order], check[order], ids[order]
    order, groups = _split(keys, n)
    keys, check, ids = keys[order], check[order], ids[order]
    return [
        {"bucket": k, "chunk": chunk, "keys": keys[a:b].tobytes(), "extra": check[a:b].tobytes(), "first": ids[a:b].tobytes()}
        for k, a, b in groups
    ]


def _first_reply(level: int, name_first: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        check = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("extra").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("first").to_pylist()])
        source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.lexsort((ids, check, keys))
        k, c, i = keys[order], check[order], ids[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        late = order[i > least]
        late = late[np.argsort(source[late], kind="stable")]
        cuts = np.searchsorted(source[late], np.arange(len(lists) + 1))
        rows = []
        for chunk, a, b in zip(table.column("chunk").to_pylist(), cuts, cuts[1:]):
            if b > a:
                mine = late[a:b][np.argsort(keys[late[a:b]], kind="stable")]
                first = least[rank[mine]].tobytes() if name_first else None
                rows.append({"chunk": chunk, "level": level, "keys": keys[mine].tobytes(), "extra": check[mine].tobytes(), "first": first})
        return _pack(rows, _REPLIES)

    return run


def first_replies(parts: DataFrame, level: int, name_first: bool = False) -> DataFrame:
    """For each chunk the keys of which another chunk has a smaller document, and on demand that document."""
    return parts.groupBy("bucket").applyInArrow(_first_reply(level, name_first), REPLIES)


def is_later(
    replies: dict[int, tuple[np.ndarray, np.ndarray]], level: int, ids: np.ndarray, keys: np.ndarray, check: np.ndarray
) -> np.ndarray:
    """Which of a chunk's occurrences (id, key) have the same key in a document with a smaller id."""
    if not len(keys):
        return np.zeros(0, bool)
    known, checks = replies[level]
    out = np.zeros(len(keys), bool)
    if len(known):
        place = np.searchsorted(known, keys)
        place[place == len(known)] = 0
        out = (known[place] == keys) & (checks[place] == check)
    order = np.lexsort((ids, check, keys))
    k, c, i = keys[order], check[order], ids[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    out[order[i > least]] = True
    return out


# -- chunk tasks


def read_replies(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``level -> (keys in order, their checks)``; levels without a reply are empty."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    level = np.array(table.column("level").to_pylist(), dtype=np.int64)
    keys, extra = table.column("keys").to_pylist(), table.column("extra").to_pylist()
    for one in range(8):
        mine = np.flatnonzero(level == one)
        joined = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(keys[i], np.uint64) for i in mine)])
        checks = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(extra[i], np.uint32) for i in mine if extra[i] is not None)])
        order = np.argsort(joined, kind="stable")
        out[one] = joined[order], checks[order] if len(checks) else checks
    return out


class Chunk:
    """Rows of one chunk: ids (a null id counts as no document), texts, and the hash of each text."""

    def __init__(self, table: pa.Table):
        self.number = table.column("chunk")[0].as_py() if table.num_rows else -1
        ids = table.column("doc_id").combine_chunks()
        self.has_id = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts: Texts = texts(table.column("text"))
        h1 = table.column("h1").to_numpy().astype(np.int64).view(np.uint64)
        h2 = table.column("h2").to_numpy().astype(np.int64).view(np.uint64)
        # The JVM's hash of a text is not changed, only mixed so that its upper bits deal evenly.
        self.text_key = h1 ^ (h2 >> np.uint64(32) << np.uint64(32))
        self.text_check = h2.astype(np.uint32)

    def take(self, rows: np.ndarray) -> Texts:
        """Texts of some rows only."""
        t = self.texts
        size = np.diff(t.offsets)[rows]
        offsets = np.append(0, np.cumsum(size))
        data = np.concatenate([np.zeros(0, np.uint8), *(t.data[t.offsets[r] : t.offsets[r + 1]] for r in rows)])
        return Texts(data, offsets)


COPIES = 0


def _copy_parts(n: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        valid = table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        ids = table.column("doc_id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h1 = table.column("h1").to_numpy().astype(np.int64).view(np.uint64)
        h2 = table.column("h2").to_numpy().astype(np.int64).view(np.uint64)
        key = h1 ^ (h2 >> np.uint64(32) << np.uint64(32))
        chunk = table.column("chunk")[0].as_py()
        return _pack(first_parts(chunk, ids[valid], key[valid], h2.astype(np.uint32)[valid], n), _PARTS)

    return run


def copy_replies(chunks: DataFrame) -> DataFrame:
    """Texts that occur whole in a document with a smaller id, for each chunk."""
    n = buckets(chunks)
    slim = chunks.select("chunk", "doc_id", "h1", "h2")
    return first_replies(slim.groupBy("chunk").applyInArrow(_copy_parts(n), PARTS), COPIES, name_first=True)


def copies(chunk: Chunk, replies: dict) -> np.ndarray:
    """Rows whose whole text an earlier document has; rows without an id are none."""
    out = np.zeros(len(chunk.ids), bool)
    rows = np.flatnonzero(chunk.has_id)
    out[rows] = is_later(replies, COPIES, chunk.ids[rows], chunk.text_key[rows], chunk.text_check[rows])
    return out


def originals(chunk: Chunk, table: pa.Table) -> np.ndarray:
    """For every row the smallest id of a document with the same text, at most its own."""
    known, firsts = {}, {}
    for level, keys, checks, ids in zip(*(table.column(c).to_pylist() for c in ("level", "keys", "extra", "first"))):
        if level == COPIES:
            pairs = zip(np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(checks, np.uint32).tolist())
            known.update(zip(pairs, np.frombuffer(ids, np.int64).tolist()))
    pairs = list(zip(chunk.text_key.tolist(), chunk.text_check.tolist()))
    for pair, i, valid in zip(pairs, chunk.ids.tolist(), chunk.has_id.tolist()):
        if valid:
            firsts[pair] = min(i, firsts.get(pair, i))
    return np.array([min(known.get(p, i), firsts.get(p, i)) if v else i for p, i, v in zip(pairs, chunk.ids.tolist(), chunk.has_id.tolist())], np.int64)


def per_chunk(chunks: DataFrame, replies: DataFrame, run: Callable[[Chunk, dict], pa.Table], schema: str) -> DataFrame:
    """Apply ``run(chunk, replies)`` to every chunk and the replies it has got."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = read_replies(right)
        replies["table"] = right
        return run(Chunk(left), replies)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def parts_table(rows: list[dict]) -> pa.Table:
    return _pack(rows, _PARTS)
