"""Approximate top-k cosine search by random projections.

The signs of a vector's products with random directions are its bucket in a table; near vectors
often share one in some of several tables. A search looks into the bucket of the query and into those
across its nearest borders, and the points found there are scored exactly.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from txnlens.operators import search as exact
from txnlens.operators.joins import BROADCAST_BYTES, table_bytes
from txnlens.operators.search import SCORE_DECIMALS
from txnlens.session import materialize

# The workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = 12
PROBES = 4
# Points a bucket should have, and from how many on it is dealt to several tasks.
BUCKET_POINTS = 64
HOT_POINTS = 4096


@dataclass(frozen=True)
class Index:
    """``entries`` is ``(table, bucket, part, id)``, stored; ``hot`` has the buckets in several parts."""

    points: DataFrame
    entries: DataFrame
    hot: DataFrame
    id: str
    width: int
    tables: int
    bits: int
    seed: int


def _planes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, tables * bits))


def _sides(column: pa.Array, planes: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the unit vectors by table, the buckets, and which rows have a length."""
    rows, usable = exact._unit(column)
    if len(rows) and rows.shape[1] != len(planes):
        raise ValueError(f"vectors have {rows.shape[1]} values instead of {len(planes)}")
    sides = (rows.reshape(-1, len(planes)) @ planes).reshape(len(rows), tables, planes.shape[1] // tables)
    return sides, (sides > 0) @ (1 << np.arange(sides.shape[2], dtype=np.int64)), usable


def build_index(collection: DataFrame, tables: int = TABLES, bits: int | None = None, seed: int = 1, id: str = "id") -> Index:
    """Index the points ``(id, vector)``; null and zero vectors are left out, ids must be unique.

    ``bits`` follows from the number of points unless given: a bucket more than BUCKET_POINTS then
    is one that many near points share. Buckets above HOT_POINTS are dealt into parts by a hash of the
    id, so that no task holds more than a part.
    """
    points = collection.filter(F.col("vector").isNotNull()).select(id, "vector")
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1
    bits = bits or max(1, min(30, round(math.log2(max(n, 1) / BUCKET_POINTS)))) if n > BUCKET_POINTS or bits else 1
    planes = _planes(width, tables, bits, seed)
    schema = T.StructType([T.StructField("id", points.schema[id].dataType), T.StructField("buckets", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, buckets, usable = _sides(batch.column(1), planes, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * tables), pa.array(buckets.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(usable)), lists], schema=arrow)

    entries = materialize(points.mapInArrow(coded, schema).select("id", F.posexplode("buckets").alias("table", "bucket")), "buckets")
    # At most one row for each HOT_POINTS entries.
    sizes = entries.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_POINTS)
    hot = materialize(sizes.select("table", "bucket", F.ceil(F.col("n") / HOT_POINTS).cast("int").alias("parts")), "hot")
    dealt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0).cast("int")
    entries = entries.join(_small(hot), ["table", "bucket"], "left").select("table", "bucket", dealt.alias("part"), "id")
    return Index(points, materialize(entries, "index"), hot, id, width, tables, bits, seed)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def _probed(side: np.ndarray, probes: int) -> Iterator[int]:
    """Buckets of one table in order of how far they are: sets of signs changed, by the sum of squared products."""
    order = np.argsort(np.abs(side), kind="stable")
    cost = side[order] ** 2
    own = int((side > 0) @ (1 << np.arange(len(side), dtype=np.int64)))
    yield own
    # Sets in order of cost: extend a set by the next place, or move its last place on.
    heap = [(cost[0], (0,))]
    for _ in range(min(probes, 1 << len(side)) - 1):
        total, places = heapq.heappop(heap)
        yield own ^ sum(1 << int(order[p]) for p in places)
        last = places[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total + cost[last + 1], (*places, last + 1)))
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))


def candidates(index: Index, queries: DataFrame, probes: int = PROBES, query_id: str = "query_id") -> DataFrame:
    """``(query_id, id)``: the points in the buckets that the queries look into, each pair once."""
    tables, planes = index.tables, _planes(index.width, index.tables, index.bits, index.seed)
    schema = T.StructType([T.StructField("query", queries.schema[query_id].dataType), T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, _, usable = _sides(batch.column(1), planes, tables)
            names = batch.column(0).filter(pa.array(usable))
            found = [(q, t, b) for q in range(len(sides)) for t in range(tables) for b in _probed(sides[q, t], probes)]
            at, table, bucket = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at, pa.int64())), pa.array(table, pa.int32()), pa.array(bucket, pa.int64())], schema=arrow)

    asked = queries.filter(F.col("vector").isNotNull()).select(query_id, "vector").mapInArrow(run, schema)
    # A bucket in parts is looked up in each of them.
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    asked = asked.join(_small(index.hot), ["table", "bucket"], "left").select("query", "table", "bucket", every.alias("part"))
    met = asked.join(index.entries, ["table", "bucket", "part"])
    return met.select(F.col("query").alias(query_id), F.col("id").alias(index.id)).distinct()


def _cosines(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) for v in (x, y))
        lengths = np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1))
        return pa.array((left * right).sum(axis=1) / lengths)

    return run(a, b)


def search(index: Index, queries: DataFrame, k: int = 20, probes: int = PROBES, query_id: str = "query_id") -> DataFrame:
    """``(query_id, id, score, dense_rank)`` like the exact search, from the candidates alone.

    Every score is exact; a point that shares no bucket looked into with a query is not found, and
    a query has fewer than ``k`` hits if it has fewer candidates. ``recall`` measures what is found.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = materialize(queries.filter(F.col("vector").isNotNull()).select(query_id, "vector"), "asked")
    vectors = asked.select(query_id, F.col("vector").alias("_asked"))
    pairs = candidates(index, asked, probes, query_id).join(index.points, index.id).join(_small(vectors), query_id)
    scored = pairs.select(query_id, index.id, _cosines(F.col("vector"), F.col("_asked")).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.round("score", SCORE_DECIMALS).desc(), F.col(index.id))
    return scored.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def recall(index: Index, queries: DataFrame, k: int = 20, probes: int = PROBES, query_id: str = "query_id") -> DataFrame:
    """``(query_id, recall)``: the share of a query's exact hits that the search finds, by brute force."""
    wanted = exact.search(queries, index.points, k, query_id, index.id).select(query_id, index.id)
    found = search(index, queries, k, probes, query_id).select(query_id, index.id, F.lit(1).alias("_hit"))
    return wanted.join(found, [query_id, index.id], "left").groupBy(query_id).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
