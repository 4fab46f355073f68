"""Near-duplicate vectors by overlapping shards.

Vectors are dealt into overlapping shards around sampled pivots, and each shard is compared in full,
in tiles where it is too large for a task. The recall is audited against brute force on vectors drawn
without regard to what was found: if it is too low, the shards overlap more, and in the end all
vectors of a label are compared.

``pruned_graph`` and ``search_in_range`` search a flat proximity graph whose adjacency lists are
pruned robustly (an edge goes if a kept neighbour is much nearer to its end). Shards are not searched
by it: building it compares all vectors of a shard already, and a search can miss whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.components import components, stars
from txnlens.session import materialize

# Vectors per pivot, and bytes of pivots that are broadcast at most: beyond, shards grow instead.
SHARD = 1024
PIVOT_BYTES = 16 << 20
# Vectors of a shard that one task compares; larger shards are cut into tiles of half this size.
LARGEST = 4096
DEGREE = 24
POOL = 64
BEAM = 32
ALPHA = 1.2
OVERLAPS = (3, 6, 12)
# Vectors with links that are compared with all others to measure the recall, the most that are drawn for
# that, the least a class of them is judged by alone, and the recall that is asked for.
AUDITED = 512
DRAWN = 16384
DRAWN_BYTES = 16 << 20
CLASS = 50
RECALL = 0.97

_LINKS = "a long, b long, n_links long"


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def pruned_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency lists, padded with -1: from the nearest ``POOL`` vectors, robustly pruned."""
    m, pool = len(x), min(POOL, len(x) - 1)
    out = np.full((m, degree), -1, np.int64)
    for a in range(0, m, 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        ids = np.argpartition(-near, pool - 1, axis=1)[:, :pool] if pool < m - 1 else np.argsort(-near, axis=1)[:, :pool]
        sims = np.take_along_axis(near, ids, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * sims))
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qid,qjd->qij", x[ids], x[ids], optimize=True)))
        alive = np.ones(ids.shape, bool)
        rows = np.arange(len(ids))
        for k in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[a + rows[some], k] = ids[rows[some], first[some]]
            alive &= ~((alpha * among[rows, first] <= far) | (np.arange(pool) == first[:, None])) | ~some[:, None]
    return out


def search_in_range(x: np.ndarray, near: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, found)`` at or above the cosine ``least``: all vectors are queries."""
    m = len(x)
    start = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((m, m), bool)
    beam = min(BEAM, m)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf)
    done = np.zeros((m, beam), bool)
    ids[:, 0], sims[:, 0], seen[:, start] = start, x @ x[start], True
    hits = [(np.flatnonzero(sims[:, 0] >= least), np.full(int((sims[:, 0] >= least).sum()), start))]

    def visit(query: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of unseen neighbours; seen ones and padding get -inf. Notes those in range."""
        fresh = (nodes >= 0) & ~seen[query[:, None], nodes]
        value = np.where(fresh, np.einsum("qd,qrd->qr", x[query], x[nodes], optimize=True), -np.inf)
        q, k = np.nonzero(fresh)
        seen[query[q], nodes[q, k]] = True
        q, k = np.nonzero(value >= least)
        # A node may come twice in one step; pairs are made distinct below.
        hits.append((query[q], nodes[q, k]))
        return value, nodes

    while True:
        open_ = np.where(done | (ids < 0), -np.inf, sims)
        best = open_.argmax(axis=1)
        query = np.flatnonzero(open_.max(axis=1) > -np.inf)
        if not len(query):
            break
        done[query, best[query]] = True
        value, nodes = visit(query, near[ids[query, best[query]]])
        all_sims = np.concatenate([sims[query], value], axis=1)
        all_ids = np.concatenate([ids[query], nodes], axis=1)
        all_done = np.concatenate([done[query], np.zeros(value.shape, bool)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[query], ids[query], done[query] = (np.take_along_axis(v, order, axis=1) for v in (all_sims, all_ids, all_done))
        ids[sims == -np.inf] = -1
    at = 0
    while at < len(hits):  # expand what is in range
        query, node = hits[at]
        at += 1
        for a in range(0, len(query), 16384):
            visit(query[a : a + 16384], near[node[a : a + 16384]])
    pairs = np.unique(np.concatenate([q * m + v for q, v in hits] + [v * m + q for q, v in hits]))
    a, b = pairs // m, pairs % m
    return a[a != b], b[a != b]


def _links(reps: np.ndarray, copies: np.ndarray, homes: list, shard: int, pairs: Iterator) -> pa.Table:
    """Counts and star edges of blocks of pairs ``a, b``, each named once a direction; a pair counts in the first
    shard its ends share. All shards find all their pairs, so none is counted by a shard that misses it."""
    n_links, x, y = np.zeros(len(reps), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(len(h) for h in homes)
    home = np.array([list(h) + [-2 - i] * (width - len(h)) for i, h in enumerate(homes)], dtype=np.int64)
    for a, b in pairs:
        mine = np.ones(len(a), bool)
        for i in range(width):
            at = home[a, i]
            mine &= ~((at[:, None] == home[b]).any(axis=1) & (at >= 0) & (at < shard))
        n_links += np.bincount(a[mine], copies[b[mine]], len(reps)).astype(np.int64)
        x, y = stars(np.concatenate([x, reps[a]]), np.concatenate([y, reps[b]]))
    some = np.flatnonzero(n_links)
    return pa.table(
        {
            "a": np.concatenate([reps[some], x]),
            "b": pa.array(np.concatenate([reps[some], y])),
            "n_links": np.concatenate([n_links[some], np.zeros(len(x), np.int64)]),
        }
    )


def _tile(least: float):
    def run(table: pa.Table) -> pa.Table:
        reps, x, side = table.column("rep").to_numpy(), _unit(table.column("vector")), table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) or not table.column("own")[0].as_py() == 0 else left

        def pairs():
            for a in range(0, len(left), 512):
                near = x[left[a : a + 512]] @ x[right].T
                i, j = np.nonzero(near >= least - 1e-9)
                # Products of matrices round by their shape: at the bound each pair is summed by itself.
                close = np.flatnonzero(near[i, j] < least + 1e-9)
                i, j = left[a + i], right[j]
                good = reps[i] != reps[j]
                good[close] &= np.einsum("ij,ij->i", x[i[close]], x[j[close]]) >= least
                i, j = i[good], j[good]
                yield i, j
                if right is not left:
                    yield j, i

        return _links(reps, table.column("n").to_numpy(), table.column("homes").to_pylist(), table.column("shard")[0].as_py(), pairs())

    return run


def _shards(reps: DataFrame, overlap: int) -> DataFrame:
    """``reps`` with ``homes``: numbers of the ``overlap`` nearest pivots of the same label and width, or one number
    for all vectors of a label that has no more pivots than that."""
    spark = reps.sparkSession
    total, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    largest = max(1, PIVOT_BYTES // (8 * (width or 1)))
    step = max(SHARD, -(-(total or 0) // largest))
    chosen = reps.filter(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(step)) == 0).select("part", "rep", "vector").orderBy("rep").limit(largest)
    found = chosen.collect()  # at most PIVOT_BYTES of vectors
    by_part: dict = {}
    for number, row in enumerate(found):
        by_part.setdefault(row["part"], ([], []))
        by_part[row["part"]][0].append(number)
        by_part[row["part"]][1].append(row["vector"])
    pivots = {}
    for part, (numbers, vectors) in by_part.items():
        v = np.array(vectors, dtype=np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        # Pivots of one dense cluster stand for one shard, or they would part it at random.
        x, y = np.nonzero(v @ v.T >= 0.8)
        home = np.arange(len(v))
        a, b = stars(x[x != y], y[x != y])
        home[a] = b
        pivots[part] = v, np.array(numbers)[home]
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            part, x = batch.column(1).to_numpy(), _unit(pa.chunked_array([batch.column(2)])) if batch.num_rows and len(set(map(len, batch.column(2).to_pylist()))) == 1 else None
            homes: list = [None] * batch.num_rows
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                known = shared.value.get(int(p))
                if known is None:  # no pivot was drawn: a shard of its own, below all numbers
                    for i in mine:
                        homes[i] = [-1]
                    continue
                v, numbers = known
                if len(numbers) <= overlap:
                    for i in mine:
                        homes[i] = [int(numbers.min())]
                    continue
                rows = x[mine] if x is not None else _unit(pa.chunked_array([batch.column(2).take(pa.array(mine))]))
                nearest = np.argpartition(-(rows @ v.T), overlap - 1, axis=1)[:, :overlap]
                for i, close in zip(mine, nearest):
                    homes[i] = sorted(set(numbers[close].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(homes, pa.list_(pa.int64()))], names=["rep", "homes"])

    dealt = reps.select("rep", "part", "vector").mapInArrow(run, "rep long, homes array<long>")
    return reps.join(dealt, "rep")


def _compare(reps: DataFrame, overlap: int | None, least: float) -> DataFrame:
    """``(a, b, n_links)``: counts where ``a = b``, else star edges of the links. Without ``overlap`` a label is one shard."""
    if overlap is None:
        dealt = reps.withColumn("homes", F.array(F.lit(-1).cast("long")))
    else:
        dealt = materialize(_shards(reps, overlap), "shards")
    # Shards of labels without pivot are told apart by the label.
    member = dealt.select("rep", "n", "vector", "homes", F.explode("homes").alias("shard"), F.when(F.col("homes")[0] < 0, F.col("part")).otherwise(F.lit(0)).alias("alone"))
    sizes = member.groupBy("shard", "alone").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.when(F.col("size") <= LARGEST, F.lit(1)).otherwise(F.ceil(F.col("size") / (LARGEST / 2))).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    cut = member.join(sizes, ["shard", "alone"]).withColumn("tiles", tiles).withColumn("tile", own)
    pair = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.least("tile", t).alias("i"), F.greatest("tile", t).alias("j"), (F.col("tile") > t).cast("int").alias("side")),
    )
    spread = cut.select("*", F.explode(pair).alias("p")).select("shard", "alone", "rep", "n", "vector", "homes", "p.i", "p.j", "p.side", (F.col("p.j") - F.col("p.i")).alias("own"))
    return materialize(spread.groupBy("shard", "alone", "i", "j").applyInArrow(_tile(least), _LINKS), "links")


def _truth(reps: DataFrame, least: float) -> tuple[DataFrame, bool]:
    """``(rep, truth)``: links by brute force of vectors drawn by a hash of the vector alone, those that have any;
    and whether all vectors were drawn.

    More are drawn until ``AUDITED`` of them have links, or all are, or ``DRAWN`` or ``DRAWN_BYTES`` are reached.
    """
    spark = reps.sparkSession
    total, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    most = min(total, DRAWN, max(AUDITED, DRAWN_BYTES // (8 * (width or 1))))
    place, size = F.xxhash64("rep", F.lit("audit")), min(4 * AUDITED, most)
    while True:
        by_part = {}
        for row in reps.select("rep", "part", "vector").orderBy(place, "rep").limit(size).collect():
            by_part.setdefault(row["part"], []).append((row["rep"], row["vector"]))
        shared = spark.sparkContext.broadcast({p: (np.array([r for r, _ in v]), _unit(pa.chunked_array([pa.array([w for _, w in v])]))) for p, v in by_part.items()})

        def run(batches, shared=shared):
            links = {p: np.zeros(len(ids), np.int64) for p, (ids, _) in shared.value.items()}
            for batch in batches:
                part = batch.column(1).to_numpy()
                for p in np.unique(part):
                    if int(p) not in links:
                        continue
                    ids, q = shared.value[int(p)]
                    mine = np.flatnonzero(part == p)
                    for a in range(0, len(mine), 512):
                        some = batch.take(pa.array(mine[a : a + 512]))
                        hit = (q @ _unit(pa.chunked_array([some.column(2)])).T >= least) & (ids[:, None] != some.column(0).to_numpy()[None, :])
                        links[int(p)] += hit @ some.column(3).to_numpy()
            for p, (ids, _) in shared.value.items():
                some = np.flatnonzero(links[p])
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[p][some])], names=["rep", "truth"])

        links = reps.select("rep", "part", "vector", "n").mapInArrow(run, "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth"))
        truth = materialize(links, "truth")
        if size >= most or truth.count() >= AUDITED:
            return truth, size >= total
        size = min(4 * size, most)


def _audit(truth: DataFrame, links: DataFrame) -> float | None:
    """Share of their true links that vectors of ``truth`` have, on average over the vectors of the worst class;
    ``None`` if no vector of it has links, so that nothing is measured.

    Classes are numbers of links between powers of two, so that many small groups count beside a large one;
    those with fewer than ``CLASS`` vectors are taken together.
    """
    mine = links.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("found"))
    share = F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("truth"))
    by = truth.join(mine, "rep", "left").groupBy(F.floor(F.log2("truth")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(share).alias("found")).collect()
    few = [(n, found) for _, n, found in by if n < CLASS]
    shares = [found / n for _, n, found in by if n >= CLASS]
    if few:
        shares.append(sum(found for _, found in few) / sum(n for n, _ in few))
    return min(shares, default=None)


def dedup_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors (vec_id, embedding, label)``.

    Vectors with equal labels are linked if their cosine is at least ``least``. Vectors that are
    null, empty, zero, or hold null or non-finite numbers, and those without label or id, link with
    nothing; neither do vectors of different widths. ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest ``vec_id`` reachable. Equal vectors of a label are
    compared once and counted each. Rows with equal ids are nodes of one name. Other columns are
    not looked at.
    """
    usable = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0),
        F.lit(False),
    )
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    part = F.xxhash64("label", F.size("vector"))
    keyed = slim.filter(usable).select("vec_id", part.alias("part"), "vector", F.md5(F.to_json(F.struct("label", "vector"))).alias("key"))
    copies = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies, "copies")
    firsts = keyed.dropDuplicates(["vec_id", "key"]).join(copies.withColumnRenamed("key", "rep_key"), (F.col("vec_id") == F.col("rep")) & (F.col("key") == F.col("rep_key")))
    # An id may name several vectors, so vectors are numbered by themselves.
    reps = materialize(firsts.select(F.xxhash64("key").alias("rep"), F.col("rep").alias("low"), "n", "part", "vector"), "vectors")
    truth, complete = _truth(reps, least)
    for overlap in (*OVERLAPS, None):
        links = _compare(reps, overlap, least)
        recall = None if overlap is None else _audit(truth, links)
        # Without a linked vector among those drawn nothing is known, unless all were drawn.
        if recall is not None and recall >= RECALL or recall is None and complete:
            break
    counts = links.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("others"))
    low = reps.select("rep", "low")
    edges = (
        links.filter("a <> b")
        .join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a")
        .join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b")
    )
    same = copies.select("key", F.xxhash64("key").alias("rep"), F.col("rep").alias("low"), "n")
    named = keyed.select("vec_id", "key").join(same.select("key", "low"), "key").select("vec_id", "low")
    component = components(edges.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")).unionByName(_several(named)))
    rows = slim.select("vec_id", F.when(usable, F.md5(F.to_json(F.struct("label", "vector")))).alias("key"))
    found = rows.join(same.join(counts, "rep", "left").select("key", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "key", "left")
    out = found.join(component.select(F.col("node").alias("low"), "component"), "low", "left")
    own = F.coalesce("component", "low", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def _several(named: DataFrame) -> DataFrame:
    """Edges between the groups of copies that one id belongs to; only ids given to several vectors have any."""
    several = named.groupBy("vec_id").agg(F.min("low").alias("first"), F.max("low").alias("last")).filter("first <> last").select("vec_id", "first")
    return named.join(several, "vec_id").filter("low <> first").select(F.col("first").alias("a"), F.col("low").alias("b"))
