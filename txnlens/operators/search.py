"""Exact top-k cosine search of many queries, and reranking of the hits."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txnlens.functions.text import terms
from txnlens.operators.embedding import embed
from txnlens.session import materialize, shuffle_partitions

# The workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scores closer than single precision resolves are ties, which the smaller id wins.
SCORE_DECIMALS = 7
# Bytes of vectors in a block of queries or points.
BLOCK_BYTES = 4 << 20
# Queries of up to this many bytes are broadcast; more meet the points in the tiles of a grid.
BROADCAST_BYTES = 64 << 20
# Bytes of points in a tile, about; its queries have up to BROADCAST_BYTES.
TILE_BYTES = 128 << 20
# Scores a task holds at a time, and candidates it keeps before it passes them on.
SCORE_CELLS = 4 << 20
KEPT = 1 << 20
# Pairs a model scores at a time.
PAIR_BATCH = 32
# Hits are four numbers or a short id each: at most some 10 MB.
BROADCAST_HITS = 200_000


def search(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 20,
    query_id: str = "query_id",
    id: str = "id",
    block_bytes: int = BLOCK_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
    stored: bool = False,
) -> DataFrame:
    """``(query_id, id, score, dense_rank)``: the ``k`` nearest points of each query.

    Both frames have a ``vector``. Queries and points are packed into blocks where they are, every
    block of points meets every block of queries in a task, and a task scores two blocks as one
    matrix product and passes on at most ``k`` candidates per query. Queries beyond
    ``broadcast_bytes`` are dealt into rows and points into columns of a grid; each of its tiles is
    a task of its own, so no task takes in more than one tile however many there are. The queries
    are stored once, unless they are ``stored`` already. Every point is scored: the result is
    exact. Null and zero vectors have no cosine and drop out.
    """
    if k < 1:
        raise ValueError("k must be positive")
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id, collection.schema[id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    asked = queries.filter(F.col("vector").isNotNull()).select(F.col(query_id).alias("name"), "vector")
    asked = asked if stored else materialize(asked, "asked")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    held = n * 8 * (width or 1)
    n_blocks = max(1, -(-held // block_bytes))
    packed_schema = _packed(schema[query_id], "asked", block=True)
    names = to_arrow_schema(T.StructType([schema[id]]))[0].type
    points = collection.filter(F.col("vector").isNotNull()).select(id, "vector")
    blocks = points.mapInArrow(_pack_points(names, block_bytes), _packed(schema[id], "points"))
    arrow = to_arrow_schema(schema)
    if held <= broadcast_bytes:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        # They fit a task, since each task gets all of them.
        packed = asked.coalesce(1).mapInArrow(_pack_all(max(1, -(-n // n_blocks))), packed_schema)
        met = blocks.select("points_names", "points", every.alias("block")).join(F.broadcast(packed), "block")
        met = met.select("block", "asked_names", "asked", "points_names", "points")
        found = met.mapInArrow(_scorer(k, arrow), schema)
    else:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(n_blocks)).cast("int"))
        packed = dealt.groupBy("block").applyInArrow(_pack_queries, packed_schema)
        n_rows = min(n_blocks, -(-held // max(1, broadcast_bytes)))
        wanted = -(-points.count() * 8 * width // tile_bytes)
        n_columns = max(1, wanted, -(-shuffle_partitions(queries.sparkSession) // n_rows))
        found = _tiles(materialize(packed, "queries"), blocks, n_rows, n_columns).applyInArrow(_tile_scorer(k, arrow), schema)
    order = Window.partitionBy(query_id).orderBy(F.round("score", SCORE_DECIMALS).desc(), F.col(id))
    return found.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def _tiles(packed: DataFrame, blocks: DataFrame, n_rows: int, n_columns: int):
    """Blocks of queries and of points by the tiles they meet in: a block of queries goes to each tile
    of its row, a block of points to each of its column."""
    row, column = F.pmod(F.col("block"), F.lit(n_rows)), F.pmod(F.xxhash64("points_names"), F.lit(n_columns)).cast("int")
    across = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda c: row * n_columns + c))
    down = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda r: r * n_columns + column))
    left = packed.select("block", "asked_names", "asked", across.alias("tile")).groupBy("tile")
    return left.cogroup(blocks.select("points_names", "points", down.alias("tile")).groupBy("tile"))


def _packed(name: T.StructField, kind: str, block: bool = False) -> T.StructType:
    fields = [T.StructField(f"{kind}_names", T.ArrayType(name.dataType)), T.StructField(kind, T.BinaryType())]
    return T.StructType([T.StructField("block", T.IntegerType())] * block + fields)


def _unit(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors scaled to length 1, and which rows have a length; all must have one width."""
    widths = np.unique(np.diff(column.offsets.to_numpy()))
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    width = int(widths[0]) if len(widths) else 0
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    lengths = np.sqrt(np.sum(rows * rows, axis=1))
    usable = lengths > 0
    return rows[usable] / lengths[usable, None], usable


def _pack_queries(table: pa.Table) -> pa.Table:
    rows, usable = _unit(table.column("vector").combine_chunks())
    names = table.column("name").combine_chunks().filter(pa.array(usable))
    listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
    return pa.table({"block": table.column("block").slice(0, 1), "asked_names": listed, "asked": pa.array([rows.tobytes()])})


def _pack_all(rows_per_block: int):
    """All queries in blocks of so many rows, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        for block, at in enumerate(range(0, table.num_rows if held else 0, rows_per_block)):
            part = table.slice(at, rows_per_block)
            numbered = part.append_column("block", pa.array([block] * part.num_rows, pa.int32()))
            yield from _pack_queries(numbered).to_batches()

    return run


def _pack_points(names: pa.DataType, block_bytes: int):
    schema = pa.schema([("points_names", pa.list_(names)), ("points", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, usable = _unit(batch.column(1))
            kept = batch.column(0).filter(pa.array(usable))
            step = max(1, block_bytes // max(8, 8 * rows.shape[1]))
            for at in range(0, len(rows), step):
                part = kept.slice(at, step)
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))
                yield pa.RecordBatch.from_arrays([listed, pa.array([rows[at : at + step].tobytes()])], schema=schema)

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of one query's candidates, best first."""
    rounded = np.round(scores, SCORE_DECIMALS)
    if len(scores) > k:
        kept = rounded >= np.partition(rounded, len(scores) - k)[len(scores) - k]
        scores, ids, rounded = scores[kept], ids[kept], rounded[kept]
    _, id_order = np.unique(ids, return_inverse=True)
    order = np.lexsort((id_order, -rounded))[:k]
    return scores[order], ids[order]


def _score(pairs: Iterator[tuple], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Best ``k`` points per query among pairs of blocks: number, names and values of the queries,
    names and values of the points."""

    def take_in(points: np.ndarray, ids: np.ndarray, matrix: np.ndarray, top: list, floor: np.ndarray) -> None:
        """Merge some points into the best so far; only scores not below the floor can change those."""
        scores = points @ matrix.T
        candidate = np.round(scores, SCORE_DECIMALS) >= floor
        for q in np.flatnonzero(candidate.any(axis=0)):
            new = candidate[:, q]
            old_scores, old_ids = top[q]
            all_ids = np.concatenate([old_ids, ids[new]]) if len(old_ids) else ids[new]
            top[q] = _best(np.concatenate([old_scores, scores[new, q]]), all_ids, k)
            if len(top[q][0]) == k:
                floor[q] = np.round(top[q][0][-1], SCORE_DECIMALS)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for names, top, _ in best.values():
            found = [(names[q], i, s) for q, (scores, ids) in enumerate(top) for i, s in zip(ids, scores)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(zip(*found), schema)], schema=schema
                )
        best.clear()

    best: dict = {}  # block of queries: names, candidates, rounded score of the k-th best
    for block, names, asked, ids, values in pairs:
        if not names:
            continue
        matrix = np.frombuffer(asked, np.float64).reshape(len(names), -1)
        points = np.frombuffer(values, np.float64).reshape(len(ids), -1)
        if points.shape[1] != matrix.shape[1]:
            raise ValueError(f"points have {points.shape[1]} values and queries {matrix.shape[1]}")
        if block not in best:
            if sum(len(b[0]) for b in best.values()) * k > KEPT:
                yield from passed_on()
            best[block] = names, [(np.empty(0), np.empty(0))] * len(names), np.full(len(names), -np.inf)
        _, top, floor = best[block]
        step = max(1, SCORE_CELLS // len(names))
        for at in range(0, len(ids), step):
            take_in(points[at : at + step], ids[at : at + step], matrix, top, floor)
    yield from passed_on()


def _scorer(k: int, schema: pa.Schema):
    """Partition function over rows that hold a block of queries and one of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (
            (
                batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_buffer(),
                batch.column(3)[row].values.to_numpy(zero_copy_only=False), batch.column(4)[row].as_buffer(),
            )
            for batch in batches
            for row in range(batch.num_rows)
        )
        yield from _score(pairs, k, schema)

    return run


def _tile_scorer(k: int, schema: pa.Schema):
    """Function of one tile: its blocks of queries and its blocks of points."""

    def run(asked: pa.Table, points: pa.Table) -> pa.Table:
        rows = [(points["points_names"][j].values.to_numpy(zero_copy_only=False), points["points"][j].as_buffer()) for j in range(points.num_rows)]
        queries = [(asked["block"][i].as_py(), asked["asked_names"][i].as_py(), asked["asked"][i].as_buffer()) for i in range(asked.num_rows)]
        # All points before the next block of queries: few candidates are held at a time.
        return pa.Table.from_batches(_score(((*q, *p) for q in queries for p in rows), k, schema), schema=schema)

    return run


def term_overlap(query: Column, text: Column) -> Column:
    """Default pair score: share of the distinct query words that the text holds."""
    wanted = terms(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, terms(text))), F.size(wanted)), F.lit(0.0))


# Built once per Python worker; maps a list of (query, text) pairs to their scores.
PairModel = Callable[[list[tuple[str, str]]], np.ndarray]


def pair_scorer(make_model: Callable[[], PairModel], batch_size: int = PAIR_BATCH) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` that runs a model on (query, text) pairs.

    A task makes the model once and gives it at most ``batch_size`` pairs at a time, whatever the size
    of its partition. Null texts are empty ones. A model that returns another number of scores raises.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make_model()
        for queries, texts in batches:
            scores = [np.zeros(0)]
            for at in range(0, len(queries), batch_size):
                pairs = [(q or "", t or "") for q, t in zip(queries[at : at + batch_size].to_pylist(), texts[at : at + batch_size].to_pylist())]
                found = np.asarray(model(pairs), np.float64).reshape(-1)
                if len(found) != len(pairs):
                    raise ValueError(f"the model gave {len(found)} scores for {len(pairs)} pairs")
                scores.append(found)
            yield pa.array(np.concatenate(scores))

    return run


def rerank(
    hits: DataFrame,
    query_col: str = "query",
    text_col: str = "text",
    scorer: Callable[[Column, Column], Column] | None = None,
    k: int | None = None,
    query_id: str = "query_id",
) -> DataFrame:
    """Score (query, text) pairs and rank by that score; ties keep the order of ``dense_rank``.

    ``scorer`` maps two columns to a column: an expression, or a model through ``pair_scorer``.
    """
    score = (scorer or term_overlap)(F.col(query_col), F.col(text_col))
    order = Window.partitionBy(query_id).orderBy(F.col("rerank_score").desc(), F.col("dense_rank"))
    out = hits.withColumn("rerank_score", score.cast("double")).withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def with_payload(hits: DataFrame, points: DataFrame, max_hits: int | None = None, id: str = "id") -> DataFrame:
    """Fetch the payload of the hits. If at most ``max_hits`` of them can exist and that is few, they
    are sent to the points, whose payloads then need not move."""
    few = max_hits is not None and max_hits <= BROADCAST_HITS
    return points.select(id, "payload").join(F.broadcast(hits) if few else hits, id)


def retrieve(
    queries: DataFrame,
    collection: DataFrame,
    k: int = 5,
    use_reranker: bool = True,
    fetch_k: int | None = None,
    scorer: Callable[[Column, Column], Column] | None = None,
    payloads: DataFrame | None = None,
    query_id: str = "query_id",
    query_col: str = "query",
) -> DataFrame:
    """Dense search with payload, then rerank: ``(query_id, query, id, score, payload, rerank_score, rank)``.

    ``queries`` has the question and its ``vector``. By default the second stage only reorders the
    ``k`` hits of the first; ``fetch_k`` lets it choose from more. ``payloads`` holds the payloads
    where they are stored apart from the vectors.
    """
    fetch_k = fetch_k or k
    queries = materialize(queries.select(query_id, query_col, "vector"), "asked")
    hits = search(queries, collection, fetch_k, query_id, stored=True)
    hits = with_payload(hits, collection if payloads is None else payloads, queries.count() * fetch_k)
    hits = hits.join(queries.select(query_id, query_col), query_id)
    if use_reranker:
        ranked = rerank(hits.withColumn("_text", F.col("payload.text")), query_col, "_text", scorer, k, query_id)
    else:
        ranked = hits.withColumns({"rerank_score": F.lit(None).cast("double"), "rank": F.col("dense_rank")}).filter(
            F.col("rank") <= k
        )
    return ranked.select(query_id, query_col, "id", "score", "payload", "rerank_score", "rank")


def embed_and_retrieve(questions: DataFrame, collection: DataFrame, dim: int, k: int = 5, **options) -> DataFrame:
    """Questions ``(query_id, query)`` to ranked hits with the default encoder."""
    return retrieve(embed(questions, "query", "query", dim=dim), collection, k, **options)
