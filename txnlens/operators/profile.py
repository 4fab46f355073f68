"""Profiles of query results and text collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions.text import word_count


def profile(df: DataFrame) -> DataFrame:
    """``(field, n_rows, min, mean, max)`` of every numeric or boolean field, from one pass."""
    fields = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    if not fields:
        raise ValueError("no numeric field to profile")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(fields):
        dtype = df.schema[name].dataType
        number = F.col(name).cast("double") if not isinstance(dtype, T.BooleanType) else F.col(name).cast("int").cast("double")
        aggs += [F.min(number).alias(f"_min{i}"), F.avg(number).alias(f"_mean{i}"), F.max(number).alias(f"_max{i}")]
    row = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col("n_rows"),
                F.col(f"_min{i}").alias("min"),
                F.col(f"_mean{i}").alias("mean"),
                F.col(f"_max{i}").alias("max"),
            )
            for i, name in enumerate(fields)
        ]
    )
    return df.agg(*aggs).select(F.inline(row))


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of texts, sums and means of characters and words, fewest and most words."""
    sized = df.select(F.length(text).cast("bigint").alias("c"), word_count(F.col(text)).cast("bigint").alias("w"))
    return sized.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"),
        F.avg("c").alias("chars_per_text"),
        F.avg("w").alias("words_per_text"),
        F.min("w").alias("min_words"),
        F.max("w").alias("max_words"),
    )
