"""Paragraph tables and chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.schemas import CHUNK


def paragraphs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", style: Column | None = None
) -> DataFrame:
    """One row per line of a text: ``(doc_id, pos, style_name, text)``.

    ``style`` may use the line number ``pos``; without it no paragraph has a style.
    """
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "text"))
    return lines.select("doc_id", "pos", (F.lit("") if style is None else style).alias("style_name"), "text")


def read_chunks(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Chunk records from JSON Lines, or from files that each hold one JSON array if ``arrays`` is set.

    Lines are split between tasks; an array is one value and one task reads each file of it. Every
    file of a folder has the format that is asked for: one that has not raises when it is read.
    """
    return spark.read.schema(CHUNK).json(path, multiLine=arrays, mode="FAILFAST")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines in UTF-8, non-ASCII characters kept as they are; null fields are written."""
    chunks.select("chunk_id", "doc_id", "section", "subsection", "block_index", "chunk_index", "text").write.mode(
        mode
    ).option("ignoreNullFields", False).json(path)
