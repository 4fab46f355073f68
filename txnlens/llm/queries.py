"""The operators over the given tables, with the parameters they are meant to run with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.automaton import decode, encode
from txnlens.llm.decontaminate import find_items
from txnlens.llm.graph_dedup import dedup_vectors
from txnlens.llm.lines import drop_template_lines
from txnlens.llm.mixing import mix
from txnlens.llm.ngram_join import join_similar
from txnlens.llm.phrases import collocations
from txnlens.llm.spelling import group_variants
from txnlens.llm.substring import remove_repeated_runs
from txnlens.llm.suffix import remove_repeated_bytes
from txnlens.llm.tokens import count_tokens
from txnlens.llm.toxicity import score_toxicity
from txnlens.llm.urls import Rule, judge

URL_RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)
# Where no rule of the site list fits: host labels that sell rather than tell.
URL_PATTERNS = tuple(Rule(f"^{word}^", "block", pattern=True) for word in ("casino", "cheap", "pills", "bets", "viagra", "porn"))
# Exponent of the sizes of sources: between even shares (0) and the shares they have (1).
MIX_ALPHA = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), MIX_ALPHA, seed=1)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_runs(_table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_template_lines(_table(spark, sf_dir, "documents"), min_docs=3, depth=6)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES + URL_PATTERNS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=0.08, recall=0.98)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"), least_length=6, least=5, times=5)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, top=2000)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_collocations": op13_collocations,
}
