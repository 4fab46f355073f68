"""Data checks. Each returns the violations as a frame; an empty frame means the check holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLINT = (-32768, 32767)


def check_pk(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are null in any part or occur more than once, with their number of rows."""
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter((F.col("n_rows") > 1) | missing)


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once; rows with a null part are exempt."""
    return (
        df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def check_fk(df: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a partner, with their number of rows; null passes.

    The rows are reduced to one per key before the anti join.
    """
    used = df.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(dim.select(F.col(pk).alias(fk)), fk, "left_anti")


def check_width(df: DataFrame, column: str, max_chars: int) -> DataFrame:
    """Rows whose text is longer than allowed."""
    return df.filter(F.length(column) > max_chars)


def check_smallint(df: DataFrame, column: str) -> DataFrame:
    """Rows whose number does not fit a two-byte integer."""
    return df.filter(~F.col(column).between(*SMALLINT))


def null_audit(df: DataFrame) -> DataFrame:
    """``(column_name, n_null)`` for every column, from one pass. NaN counts as missing."""

    def missing(name: str, dtype: str):
        gone = F.col(name).isNull()
        if dtype in ("double", "float"):
            gone = gone | F.isnan(name)
        return F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).alias(name)

    counts = df.agg(*[missing(name, dtype) for name, dtype in df.dtypes])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def align_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Full outer match of chunks and vectors by key: ``(key, has_chunk, has_vector, dim)``."""
    left = chunks.select(key, F.lit(True).alias("has_chunk"))
    right = vectors.select(key, F.lit(True).alias("has_vector"), F.size(vector).alias("dim"))
    return left.join(right, key, "full_outer").select(
        key,
        F.coalesce("has_chunk", F.lit(False)).alias("has_chunk"),
        F.coalesce("has_vector", F.lit(False)).alias("has_vector"),
        "dim",
    )


def check_vectors(chunks: DataFrame, vectors: DataFrame, dim: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Chunks without vector, vectors without chunk, and vectors of the wrong length."""
    aligned = align_vectors(chunks, vectors, key, vector)
    return aligned.filter(~F.col("has_chunk") | ~F.col("has_vector") | (F.col("dim") != dim))


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise if a check found anything."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")
