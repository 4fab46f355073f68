"""Vector collections: points ``(id, vector, payload)`` of one fixed dimension.

A collection is one Parquet table, or is laid out in buckets by the hash of the id, of which an
upsert replaces only those that it touches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.operators.checks import check_vectors, require_empty
from txnlens.schemas import COLLECTION
from txnlens.session import materialize
from txnlens.sources import versions
from txnlens.sources.versions import Version

PAYLOAD_FIELDS = ("chunk_id", "section", "subsection", "block_index", "chunk_index", "text")


def create_collection(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Replace whatever is at ``path`` by an empty collection of vectors of ``dim`` values."""
    if dim < 1:
        raise ValueError("the dimension must be positive")
    empty = spark.createDataFrame([], COLLECTION)
    empty.withMetadata("vector", {"dim": dim}).write.mode("overwrite").parquet(path)
    return read_collection(spark, path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A stored collection; its schema says the dimension it was created for."""
    return spark.read.parquet(path)


def dimension(collection: DataFrame) -> int | None:
    """The dimension a collection was created for, if it was stored as one."""
    return collection.schema["vector"].metadata.get("dim") if "vector" in collection.columns else None


def save_collection(collection: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a collection. The result of an upsert goes to a new path: it still reads the old one."""
    collection.select("id", "vector", "payload").write.mode(mode).parquet(path)


def save_vectors(embedded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors keyed by ``chunk_id``, apart from the texts."""
    embedded.select("chunk_id", "vector").write.mode(mode).parquet(path)


def points(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Join chunks with their vectors by id; any row without partner or of wrong length raises."""
    require_empty(check_vectors(chunks, vectors, dim), "chunks and vectors do not match")
    return chunks.join(vectors.select("chunk_id", "vector"), "chunk_id").select(
        F.col("chunk_id").alias("id"), "vector", F.struct(*PAYLOAD_FIELDS).alias("payload")
    )


def upsert(old: DataFrame, new: DataFrame, seq: str, key: str = "id") -> DataFrame:
    """``old`` with the points of ``new`` put in or replaced; of points with one id, the last by ``seq`` counts.

    Of several points with one id and ``seq``, that with the greatest hash of all its values counts.
    The one per id is found from narrow columns, so vectors are never gathered by id; equal rows
    count once. A vector that has not the dimension of ``old`` raises. The points that count are
    stored once: they are part of the result and also tell which old ones go.
    """
    dim = dimension(old)
    winners = _latest(new, old.columns, dim, seq, key)
    merged = old.join(winners.select(key), key, "left_anti").unionByName(winners)
    return merged if dim is None else merged.withMetadata("vector", {"dim": dim})


def _latest(new: DataFrame, columns: list[str], dim: int | None, seq: str, key: str) -> DataFrame:
    """The point of each id that counts, stored."""
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dim} values: "), F.col(key).cast("string")))
        fits = F.coalesce(F.size("vector") == dim, F.lit(False))
        new = new.withColumn("vector", F.when(fits, F.col("vector")).otherwise(wrong))
    marked = new.withColumn("_mark", F.struct(F.col(seq), F.xxhash64(*columns)))
    latest = marked.groupBy(key).agg(F.max("_mark").alias("_mark"))
    winners = marked.join(latest, [key, "_mark"], "left_semi").dropDuplicates([key]).select(*columns)
    return materialize(winners, "points")


def create_buckets(spark: SparkSession, path: str, dim: int, n_buckets: int, schema: str = COLLECTION) -> None:
    """Replace whatever is at ``path`` by an empty collection in ``n_buckets`` buckets.

    A bucket is rewritten whole when it is touched, so there should be as many as give a bucket some
    hundred MB of points.
    """
    if dim < 1 or n_buckets < 1:
        raise ValueError("dimension and number of buckets must be positive")
    base = versions.current(spark, path)
    info = {"dim": dim, "buckets": n_buckets, "schema": spark.createDataFrame([], schema).schema.json()}
    versions.switch(spark, path, Version(base.number), {}, info)


def _bucket(n_buckets: int, key: str = "id"):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, buckets: list[int] | None = None, version: Version | None = None) -> DataFrame:
    """The points of a collection in buckets, or of some of them; the files of others are not looked at."""
    version = versions.current(spark, path) if version is None else version
    if "buckets" not in version.info:
        raise ValueError(f"no collection in buckets at {path}")
    schema = T.StructType.fromJson(json.loads(version.info["schema"]))
    wanted = range(version.info["buckets"]) if buckets is None else buckets
    paths = [p for b in wanted for p in version.paths(path, f"bucket={b}")]
    points = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return points.withMetadata("vector", {"dim": version.info["dim"]})


def upsert_buckets(new: DataFrame, path: str, seq: str, key: str = "id") -> list[int]:
    """Put points into a collection in buckets, see ``upsert``; returns the buckets that were replaced.

    Only buckets that get a point are read and written; the files of all others stay as they are.
    The new ones are written beside and take effect at once, or not at all. A null id raises.
    """
    spark = new.sparkSession
    base = versions.current(spark, path)
    columns, n_buckets = read_buckets(spark, path, [], base).columns, base.info["buckets"]
    no_id = F.raise_error(F.lit("a point has no id"))
    named = new.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(no_id.cast(new.schema[key].dataType)))
    winners = _latest(named, columns, base.info["dim"], seq, key).withColumn("bucket", _bucket(n_buckets, key))
    touched = sorted(r[0] for r in winners.select("bucket").distinct().collect())  # at most n_buckets numbers
    if not touched:
        return []
    old = read_buckets(spark, path, touched, base).withColumn("bucket", _bucket(n_buckets, key))
    # Both sides have their bucket, which is part of the key, so one shuffle by it serves join and layout.
    merged = old.join(winners.select("bucket", key), ["bucket", key], "left_anti").unionByName(winners)
    part = versions.new_part("points")
    merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/{part}")
    versions.switch(spark, path, base, {f"bucket={b}": [f"{part}/bucket={b}"] for b in touched})
    return touched


def collection_info(collection: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: number of points, least and greatest dimension."""
    size = F.size(vector)
    return collection.agg(
        F.count(F.lit(1)).alias("n_points"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    )
