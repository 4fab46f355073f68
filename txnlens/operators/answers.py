"""Question answering as batch operators over a table of questions, one row each.

Texts written by models (route label, answer, judge's reply) come in as columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.scoring import base_score, final_score
from txnlens.functions.text import contains_any, snippet, strip

ROUTES = ("data", "document", "none")

# Words that send a question to the data or to the documents, tried in this order.
DATA_WORDS = (
    "rate", "trend", "daily", "monthly", "time series", "merchant", "category", "transaction", "amount", "volume",
    "count", "share", "proportion", "distribution",
)
DOCUMENT_WORDS = (
    "application fraud", "lost/stolen", "lost or stolen", "counterfeit", "skimming", "merchant collusion",
    "triangulation", "internet", "site cloning", "neural network", "fraud detection system", "total cost of fraud",
    "prevention", "white paper",
)

CONTEXT_HITS = 10
CONTEXT_CHARS = 500
EVIDENCE_HITS = 2
EVIDENCE_CHARS = 300
SOURCE_HITS = 5


def route(question: Column, label: Column | None = None) -> Column:
    """The label if it is a valid route after trimming and lower-casing, else by keywords."""
    by_words = (
        F.when(contains_any(question, DATA_WORDS), "data")
        .when(contains_any(question, DOCUMENT_WORDS), "document")
        .otherwise("none")
    )
    if label is None:
        return by_words
    given = F.lower(strip(label))
    return F.when(given.isin(*ROUTES), given).otherwise(by_words)


def by_route(routed: DataFrame, column: str = "route") -> dict[str, DataFrame]:
    """The questions of each branch; a missing or unknown route counts as ``none``."""
    kind = F.coalesce(F.when(F.col(column).isin(*ROUTES), F.col(column)), F.lit("none"))
    return {name: routed.filter(kind == name) for name in ROUTES}


def recombine(branches: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the branches after their own steps; a column that only some have is null in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches.values())


def chat_history(turns: DataFrame, exclude_last_user: bool = True) -> DataFrame:
    """``(conv_id, turn, role, content)``: the turns a question is sent with, in order of ``turn``.

    Only user and assistant turns with a text count. A user turn that ends the conversation is the
    question itself and left out. Histories stay rows: a long one is never gathered in one value.
    """
    valid = turns.filter(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )
    if not exclude_last_user:
        return valid
    # The question is the last user turn, and only if nothing follows it.
    last = turns.groupBy("conv_id").agg(F.max(F.col("turn")).alias("turn"))
    question = last.join(turns.filter(F.col("role") == "user").select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return valid.join(question, ["conv_id", "turn"], "left_anti")


def _first_hits(hits: DataFrame, n: int, line: Column, separator: str, name: str) -> DataFrame:
    """Join ``line`` of the first ``n`` hits of each question in rank order (at most ``n`` each)."""
    first = hits.filter(F.col("rank") <= n).select("question_id", "rank", line.alias("_line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_line")))
    lines = F.transform(ordered, lambda h: h["_line"])
    return first.groupBy("question_id").agg(F.array_join(lines, separator).alias(name))


def context(hits: DataFrame, n: int = CONTEXT_HITS, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``(question_id, context)``: numbered excerpts of the ranked hits."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"),
        F.lit("] Section: "), F.coalesce("section", F.lit("None")),
        F.lit(" | Subsection: "), F.coalesce("subsection", F.lit("None")),
        F.lit("\n"), snippet(F.col("text"), max_chars), F.lit("\n"),
    )
    return _first_hits(hits, n, line, "\n", "context")


def evidence(hits: DataFrame, n: int = EVIDENCE_HITS, max_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """``(question_id, evidence)``: beginnings of the first hits, a blank line between them."""
    return _first_hits(hits, n, snippet(F.col("text"), max_chars), "\n\n", "evidence")


def data_evidence(results: DataFrame, fields: Sequence[str], question_id: str = "question_id") -> DataFrame:
    """``(question_id, field, n_rows, min, mean, max)``: what the rows behind each data answer say.

    ``results`` are the result rows of many questions as rows, ``fields`` their numeric columns. Rows
    are reduced where they are; nulls count as rows, not as values.
    """
    if not fields:
        raise ValueError("no field given")
    value = {c: F.col(c).cast("double") for c in fields}
    measured = [f(value[c]).alias(f"{name}_{k}") for k, c in enumerate(fields) for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    wide = results.groupBy(question_id).agg(F.count(F.lit(1)).alias("n_rows"), *measured)
    entry = [
        F.struct(F.lit(c).alias("field"), F.col(f"min_{k}").alias("min"), F.col(f"mean_{k}").alias("mean"), F.col(f"max_{k}").alias("max"))
        for k, c in enumerate(fields)
    ]
    return wide.select(question_id, "n_rows", F.explode(F.array(*entry)).alias("e")).select(
        question_id, "e.field", "n_rows", "e.min", "e.mean", "e.max"
    )


def data_evidence_text(evidence: DataFrame, question_id: str = "question_id") -> DataFrame:
    """``(question_id, evidence)``: the row count and one line per field, fields in order of their names."""
    number = lambda c: F.coalesce(F.format_number(c, 4), F.lit("none"))
    line = F.concat("field", F.lit(": min="), number("min"), F.lit(", mean="), number("mean"), F.lit(", max="), number("max"))
    # One line per field, so as many as the schema has.
    lines = F.array_sort(F.collect_list(F.struct("field", line.alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    out = evidence.groupBy(question_id).agg(F.max("n_rows").alias("n_rows"), joined.alias("lines"))
    return out.select(question_id, F.concat(F.lit("Rows: "), F.col("n_rows").cast("string"), F.lit("\n"), F.col("lines")).alias("evidence"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """``(question_id, n_hits, mean_rerank)``; a hit without rerank score counts as 0."""
    return hits.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg(F.coalesce("rerank_score", F.lit(0.0))).alias("mean_rerank")
    )


def result_summary(sql_results: DataFrame) -> DataFrame:
    """``(question_id, n_rows)`` of query results given as ``(question_id, row_no, row_json)``."""
    return sql_results.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_rows"))


def scored(answers: DataFrame, sql_results: DataFrame, hits: DataFrame) -> DataFrame:
    """Add ``n_rows, n_hits, base_score, quality_score`` to answers
    ``(question_id, answer_type, failed, judge_text, …)``."""
    joined = answers.join(result_summary(sql_results), "question_id", "left").join(
        hit_summary(hits), "question_id", "left"
    )
    base = base_score(
        F.col("answer_type"), F.col("n_rows"), F.col("failed"), F.col("n_hits"), F.col("mean_rerank")
    )
    return (
        joined.withColumn("base_score", base)
        .withColumn("quality_score", final_score(F.col("base_score"), F.col("judge_text")))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_hits")})
        .drop("mean_rerank")
    )


def answer_records(scored_answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The answer record: text, type, score, SQL, and for documents the first hits as nested sources.

    Rows behind a data answer may be many; they stay in ``answer_rows``, counted by ``n_rows``.
    """
    source = F.struct("rank", "section", "subsection", F.col("text").alias("snippet"), "rerank_score")
    chunks = F.transform(
        F.array_sort(F.collect_list(source)),
        lambda s: F.struct(s["section"], s["subsection"], s["snippet"], s["rerank_score"]),
    )
    sources = hits.filter(F.col("rank") <= SOURCE_HITS).groupBy("question_id").agg(chunks.alias("_chunks"))
    kind = F.when(F.col("answer_type") == "data", "sql_result").when(F.col("answer_type") == "document", "document_chunks")
    return scored_answers.join(sources, "question_id", "left").select(
        "question_id",
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("answer_type", F.lit("unknown")).alias("answer_type"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        "sql",
        kind.alias("source_type"),
        F.when(F.col("answer_type") == "data", F.col("n_rows")).alias("n_rows"),
        F.when(F.col("answer_type") == "document", F.coalesce("_chunks", F.array().cast(_CHUNKS))).alias("chunks"),
    )


_CHUNKS = "array<struct<section: string, subsection: string, snippet: string, rerank_score: double>>"


def answer_rows(scored_answers: DataFrame, sql_results: DataFrame) -> DataFrame:
    """All result rows of the data answers: ``(question_id, row_no, row_json)``."""
    data = scored_answers.filter(F.col("answer_type") == "data").select("question_id")
    return sql_results.join(data, "question_id", "left_semi").select("question_id", "row_no", "row_json")


def as_result(question_id: Column, row_no: Column, rows: DataFrame) -> DataFrame:
    """Any query result as ``(question_id, row_no, row_json)``."""
    return rows.select(
        question_id.alias("question_id"), row_no.alias("row_no"), F.to_json(F.struct("*")).alias("row_json")
    )
