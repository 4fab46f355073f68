"""Documents whose sets of word n-grams overlap, by blocks of the document by n-gram matrix.

Linked sets share so many n-grams that each has one of them among its few rarest; how few follows
from its size. Rare here means: in no other document, and then in the order of a hash. Most documents
have more n-grams of their own than that bound, so they can be linked with nothing and leave the
matrix. The rest is put into blocks by the n-grams that are left of their bounds; blocks are
multiplied with themselves, which counts the overlaps, and pairs below the bound that follows from
their sizes are dropped. The counts decide alone, so the join is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import kernels as K
from txnlens.llm import repeats as R
from txnlens.llm.components import EDGES, components, stars
from txnlens.session import materialize

_FOUND = "kind int, bucket int, doc_id long, original long, n long, data binary, ids binary"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("original", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("ids", pa.binary())])
KEYS, SETS, DOCUMENTS = 0, 1, 2
# A tile of the matrix has at most about this many entries; a document counts as LEAST_ENTRIES at least.
TILE_ENTRIES = 1 << 20
LEAST_ENTRIES = 512
# N-grams in more documents of a block than this are multiplied as a dense matrix, so many at a time.
DENSE_FROM = 12
DENSE_COLUMNS = 2048


def shingles(t: K.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct shingles of every text, in order."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in K.batches(t, 4 << 20):
        part = K.Texts(t.data[t.offsets[a] : t.offsets[b]], t.offsets[a : b + 1] - t.offsets[a])
        words = K.words(part, fold_case=True)
        row, count = words.row, np.diff(words.offsets)
        found = K.window_hashes(words.hash, size)
        whole = K.inside(words.offsets, size, len(found))
        row_of, hash_of = [row[: len(found)][whole]], [found[whole]]
        for few in range(1, size):  # too few words: the whole sequence is one shingle
            short = np.flatnonzero(count == few)
            if len(short):
                row_of.append(short)
                hash_of.append(K.window_hashes(words.hash, few, salt=few)[words.offsets[short]])
        r, h = np.concatenate(row_of), np.concatenate(hash_of)
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])) if len(r) else np.zeros(0, bool)
        rows.append(r[new] + a)
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes)


def rarest(row: np.ndarray, shared: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which n-grams (in order of row and hash) a linked set must have in common: those within the bound that are
    ``shared`` at all. Of the n - ceil(n percent / 100) + 1 rarest, those of no other document come first."""
    bound = n - -(-n * percent // 100) + 1
    alone = np.bincount(row[~shared], minlength=len(n))
    place = np.cumsum(shared)  # running number of shared n-grams, made to start anew in every row
    before = np.append(0, place)[np.searchsorted(row, np.arange(len(n)))]
    return shared & (place - before[row] <= (bound - alone)[row])


def _seek(size: int, n_buckets: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        rows = np.flatnonzero(chunk.has_id & ~R.copies(chunk, replies))
        row, hashes = shingles(chunk.take(rows), size)
        return R.parts_table(R.seen_parts(chunk.number, row, hashes, n_buckets))

    return run


def _collect(size: int, percent: int, n_buckets: int):
    def run(chunk: R.Chunk, replies: dict) -> pa.Table:
        copy = R.copies(chunk, replies)
        row, hashes = shingles(chunk.texts, size)
        n = np.bincount(row, minlength=len(chunk.ids))
        original = R.originals(chunk, replies["table"])
        out = [
            {"kind": DOCUMENTS, "doc_id": i if v else None, "original": o if v else None, "n": k}
            for i, v, o, k in zip(chunk.ids.tolist(), chunk.has_id.tolist(), original.tolist(), n.tolist())
        ]
        active = chunk.has_id & ~copy
        mine = active[row]
        row, hashes = row[mine], hashes[mine]
        shared = R.is_seen(replies, 1, hashes, n_buckets)
        hit = rarest(row, shared, n, percent)
        of, key = row[hit], hashes[hit]
        order, groups = R._split(key, n_buckets)
        key, ids = key[order], chunk.ids[of[order]]
        out += [{"kind": KEYS, "bucket": k, "data": key[a:b].tobytes(), "ids": ids[a:b].tobytes()} for k, a, b in groups]
        # Only shared n-grams count in overlaps.
        row, hashes = row[shared], hashes[shared]
        cuts = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
        for i in np.unique(of):
            out.append({"kind": SETS, "doc_id": int(chunk.ids[i]), "n": int(n[i]), "data": hashes[cuts[i] : cuts[i + 1]].tobytes()})
        return pa.Table.from_pylist(out, schema=_FOUND_ARROW)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Edges between documents that share one of their rarest n-grams in this bucket."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.append(True, keys[1:] != keys[:-1])
    a, b = stars(ids, ids[np.flatnonzero(new)][np.cumsum(new) - 1])
    return pa.table({"a": a, "b": b})


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``, as a matrix.

    The incidence matrix is multiplied with its transpose in blocks of columns: rare n-grams pair
    their few documents directly, frequent ones as dense blocks.
    """
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    row, values = row[order], values[order]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    count = np.diff(np.append(start, len(values)))
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros(len(left) * len(right), np.int32)
    for times in range(2, DENSE_FROM + 1):
        first = start[count == times]
        for i in range(times):
            for j in range(times):
                x, y = at_left[row[first + i]], at_right[row[first + j]]
                both = (x >= 0) & (y >= 0)
                np.add.at(out, x[both] * len(right) + y[both], 1)
    out = out.reshape(len(left), len(right))
    often = np.flatnonzero(count > DENSE_FROM)
    for a in range(0, len(often), DENSE_COLUMNS):
        block = often[a : a + DENSE_COLUMNS]
        column = np.repeat(np.arange(len(block)), count[block])
        entry = np.repeat(start[block], count[block]) + np.arange(len(column)) - np.repeat(np.cumsum(count[block]) - count[block], count[block])
        who = row[entry]
        x = np.zeros((len(left), len(block)), np.float32)
        mine = at_left[who] >= 0
        x[at_left[who[mine]], column[mine]] = 1
        y = np.zeros((len(right), len(block)), np.float32)
        mine = at_right[who] >= 0
        y[at_right[who[mine]], column[mine]] = 1
        out += (x @ y.T).astype(np.int32)
    return out


def linked(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the documents linked in a tile; sides 0 and 1 are compared, or all with side 0 alone.

    ``sets`` hold the n-grams that other documents have too, ``n`` the sizes of the whole sets.
    """
    # A document can only be linked if enough of its n-grams occur in another one of the tile.
    size = np.array([len(x) for x in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat((count[inverse] > 1).astype(np.int64), np.append(0, np.cumsum(size)[:-1]))
    alive = np.flatnonzero(100 * shared >= percent * n)
    sets, ids, side, n = [sets[i] for i in alive], ids[alive], side[alive], n[alive]
    two = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = n[left][:, None] + n[right][None, :]
    x, y = np.nonzero((100 + percent) * overlaps(sets, left, right).astype(np.int64) >= percent * sums)
    a, b = ids[left[x]], ids[right[y]]
    return stars(a[a != b], b[a != b])


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        data, n = table.column("data").to_pylist(), table.column("n").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
        found = []
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            mine = order[a:b]
            if len(mine) > 1:
                found.append(linked(ids[mine], n[mine], [np.frombuffer(data[i], np.uint64) for i in mine], side[mine], percent))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a, "b": b})

    return run


def _tiles(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Rows of ``sets`` with the tile pairs they take part in: small blocks are packed several to a group, large ones
    cut by size range and hash; only ranges that may hold links meet."""
    weight = F.greatest("n", F.lit(LEAST_ENTRIES))
    # Ranges of sizes by logarithm: linked sets are in the same or in neighbouring ones.
    rank = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100.0 / percent)) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    slim = sets.select("doc_id", "n").distinct().join(blocks.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "doc_id")
    slim = slim.withColumns({"range": rank, "weight": weight})
    by_range = slim.groupBy("block", "range").agg(F.sum("weight").alias("weight"))
    shape = by_range.groupBy("block").agg(
        F.sum("weight").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("range", F.ceil(F.col("weight") / TILE_ENTRIES).cast("int")))).alias("tiles"),
    )
    groups = R.CHUNKS_PER_PARTITION * R.buckets(sets) * 2
    placed = slim.join(shape, "block")
    of = lambda shift: F.coalesce(F.try_element_at("tiles", F.col("range") + shift), F.lit(0))
    own = F.pmod(F.xxhash64("doc_id"), of(0)).cast("int")
    large = placed.filter(F.col("total") > TILE_ENTRIES).withColumns({"own": own, "same": of(0), "above": of(1), "below": of(-1)})
    pair = lambda r1, t1, r2, t2, side: F.struct(r1.alias("r1"), t1.alias("t1"), r2.alias("r2"), t2.alias("t2"), side.alias("side"))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    o, r = F.col("own"), F.col("range")
    pairs = F.concat(
        F.transform(span(F.col("same")), lambda t: pair(r, F.least(o, t), r, F.greatest(o, t), (o > t).cast("int"))),
        F.transform(span(F.col("above")), lambda t: pair(r, o, r + 1, t, F.lit(0))),
        F.transform(span(F.col("below")), lambda t: pair(r - 1, t, r, o, F.lit(1))),
    )
    cut = large.select("doc_id", "n", "block", F.explode(pairs).alias("p")).select("doc_id", "n", "block", F.xxhash64("block", "p.r1", "p.t1", "p.r2", "p.t2").alias("tile"), "p.side")
    packed = placed.filter(F.col("total") <= TILE_ENTRIES).select("doc_id", "n", "block", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("tile"), F.lit(0).alias("side"))
    # Several texts of one id are told apart by their sizes, or share their tiles.
    return cut.unionByName(packed).join(sets.select("doc_id", "n", "data"), ["doc_id", "n"])


def _several(rows: DataFrame) -> DataFrame:
    """Edges from ids that have several texts to the originals of those."""
    named = rows.select("doc_id", "node").filter("doc_id is not null").distinct()
    several = named.groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("doc_id")
    return named.join(several, "doc_id").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def join_similar(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents joined where ``intersection / union >= percent / 100``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z in lower case; a document is the set
    of its runs of ``size`` words, or of all its words if it has fewer. Null, empty and blank texts
    have no shingle and no link. ``component_id`` is the smallest ``doc_id`` reachable by links.
    Rows with equal ``doc_id`` are one document with several texts. Rows with a null id are returned
    with a null component and take no part. Other columns are not looked at.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    n = R.buckets(docs)
    chunks = R.in_chunks(docs)
    replies = R.copy_replies(chunks)
    parts = R.per_chunk(chunks, replies, _seek(size, n), R.PARTS)
    replies = replies.unionByName(R.seen_replies(parts, 1))
    found = materialize(R.per_chunk(chunks, replies, _collect(size, percent, n), _FOUND), "shingles")
    near = found.filter(F.col("kind") == KEYS).select("bucket", "data", "ids").groupBy("bucket").applyInArrow(_meet, EDGES)
    blocks = components(near)
    sets = found.filter(F.col("kind") == SETS).select("doc_id", "n", "data")
    links = _tiles(sets, blocks, percent).groupBy("tile").applyInArrow(_multiply(percent), EDGES)
    # A text without shingles is nobody's copy.
    node = F.when(F.col("n_shingles") > 0, F.col("original")).otherwise(F.col("doc_id")).alias("node")
    rows = found.filter(F.col("kind") == DOCUMENTS).withColumnRenamed("n", "n_shingles").select("doc_id", "n_shingles", node)
    component = components(links.unionByName(_several(rows)))
    joined = rows.join(component, "node", "left")
    own = F.coalesce("component", "node")
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one_of_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, whose ``doc_id`` is the smallest of its component; rows with a null id stay.

    See ``join_similar``. Rows with equal ids are one document, so they stay or go together.
    """
    found = join_similar(docs, size, percent).filter("component_id < doc_id")
    later = materialize(found.select(F.col("doc_id").alias("later")).distinct(), "later")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(later, F.col("id") == F.col("later"), "left_anti").select("row.*")
