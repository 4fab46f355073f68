"""Blocks to sentence chunks.

Sentences are cut and joined by column functions; only the words per sentence pass through an Arrow
kernel that finds where chunks end. Nothing is shuffled, and the work of a row is linear in its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.text import chunk_id, sentences, word_count
from txnlens.operators.ranges import chunk_ranges_of

MAX_WORDS = 256
OVERLAP = 1
MODES = ("window", "greedy")


def chunk_ranges(counts: Column, max_words: int, overlap: int, mode: str) -> Column:
    """``array<struct<a, b>>``: first and last sentence of each chunk, from words per sentence.

    A chunk closes when the next sentence would exceed ``max_words``. In mode ``greedy`` the next
    one starts with the last ``overlap`` sentences, which count; in mode ``window`` the chunks are
    disjoint at first and then extended by ``overlap`` sentences on both sides, which do not count.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if max_words < 1 or overlap < 0:
        raise ValueError("max_words must be positive and overlap not negative")
    ranges = chunk_ranges_of(counts, max_words, overlap if mode == "greedy" else 0)
    if mode == "greedy":
        return ranges
    return F.transform(
        ranges,
        lambda r: F.struct(
            F.greatest(F.lit(0), r["a"] - overlap).alias("a"),
            F.least(F.size(counts) - 1, r["b"] + overlap).alias("b"),
        ),
    )


def chunks(blocks: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, mode: str = "window") -> DataFrame:
    """``(chunk_id, doc_id, section, subsection, block_index, chunk_index, text)``."""
    cut = blocks.withColumn("_sentences", sentences(F.col("text"))).withColumn(
        "_counts", F.transform("_sentences", word_count)
    )
    cut = cut.withColumn("_ranges", chunk_ranges(F.col("_counts"), max_words, overlap, mode))
    texts = F.transform(
        "_ranges",
        lambda r: F.array_join(F.slice("_sentences", r["a"] + 1, r["b"] - r["a"] + 1), " "),
    )
    out = cut.select("doc_id", "section", "subsection", "block_index", F.posexplode(texts).alias("chunk_index", "text"))
    return out.select(
        chunk_id(F.col("doc_id"), F.col("block_index"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "section", "subsection", "block_index", "chunk_index", "text",
    )
