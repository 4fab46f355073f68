"""The given tables in the roles of the engine's inputs.

Where a table lacks a column (birth dates, coordinates), it is derived from a key by fixed arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.features import calendar_columns, with_calendar, with_features
from txnlens.functions.text import sentences
from txnlens.operators.answers import CONTEXT_HITS, route
from txnlens.operators.keys import surrogate_keys
from txnlens.operators.search import rerank
from txnlens.operators.star import Star
from txnlens.session import spread
from txnlens.sources.documents import paragraphs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with their texts, spread for the text operators."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in which every "the" is "Dr." or "approx.", by the document, and "and" is "e.g."."""
    title = F.when(F.col("doc_id") % 2 == 0, F.lit(" Dr. ")).otherwise(F.lit(" approx. "))
    text = F.replace(F.replace("text", F.lit(" the "), title), F.lit(" and "), F.lit(" e.g. "))
    return documents(spark, sf_dir).withColumn("text", text)


# --- events as raw transactions ----------------------------------------------------------------


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as typed transactions; customer attributes vary, so the first one matters."""
    k = F.get_json_object("props", "$.k").cast("int")
    user, event = F.col("user_id"), F.col("event_id")
    seconds = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    return spread(table(spark, sf_dir, "events")).select(
        event.alias("ord"),
        F.col("ts").alias("trans_ts"),
        user.cast("string").alias("cc_num"),
        F.concat(F.lit("m"), k.cast("string")).alias("merchant"),
        F.concat(F.lit("c"), (k % 7).cast("string")).alias("category"),
        F.col("value").alias("amt"),
        F.concat(F.lit("First"), user.cast("string")).alias("first"),
        F.concat(F.lit("Last"), (user % 50).cast("string")).alias("last"),
        F.when(user % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(user.cast("string"), F.lit(" Main St")).alias("street"),
        F.concat(F.lit("City"), (event % 40).cast("string")).alias("city"),
        F.concat(F.lit("S"), (user % 50).cast("string")).alias("state"),
        (F.lit(10000) + user * 7).cast("string").alias("zip"),
        ((user * 7) % 180 - 90).cast("double").alias("lat"),
        ((user * 13) % 360 - 180).cast("double").alias("long"),
        (user * 1000 + event % 10).alias("city_pop"),
        F.concat(F.lit("Job"), (user % 12).cast("string")).alias("job"),
        F.date_add(F.lit("1940-01-01").cast("date"), ((user * 137) % 20000).cast("int")).alias("dob"),
        F.concat(F.lit("t"), event.cast("string")).alias("trans_num"),
        (seconds + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("unix_time"),
        ((event * 3) % 180 - 90).cast("double").alias("merch_lat"),
        ((event * 11) % 360 - 180).cast("double").alias("merch_long"),
        (F.col("event_type") == "error").cast("smallint").alias("is_fraud"),
        F.when(event % 4 == 3, "test").otherwise("train").alias("split"),
    )


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(event_transactions(spark, sf_dir))


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event transactions where merchants from m95 up are unknown (null) and some amounts missing."""
    unknown = F.substring("merchant", 2, 3).cast("int") >= 95
    return event_transactions(spark, sf_dir).withColumns(
        {
            "merchant": F.when(~unknown, F.col("merchant")),
            "amt": F.when(F.col("amt") >= 1.0, F.col("amt")),
        }
    )


# --- line items as a star ----------------------------------------------------------------------


def _day_id(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")


def line_fact(spark: SparkSession, sf_dir: str, customer: bool = False) -> DataFrame:
    """``lineitem`` as the fact table. The customer needs a join, made only on request; the category
    hangs on the part (``part_id``)."""
    lines = with_calendar(table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "trans_ts"))
    fact = lines.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("merchant_id"),
        _day_id("trans_ts").alias("date_id"),
        "trans_ts",
        F.col("l_extendedprice").alias("amt"),
        (F.col("l_returnflag") == "R").cast("smallint").alias("is_fraud"),
        "year", "month", "hour", "is_weekend",
    )
    if not customer:
        return fact
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id")
    )
    return fact.join(orders, "l_orderkey")


def line_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("c_name", "#")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("cc_num"),
        name[0].alias("first"),
        name[1].alias("last"),
        F.col("c_mktsegment").alias("job"),
    )


def line_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name")
    )


def line_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of every part; part types are numbered by first appearance in ``part``."""
    parts = table(spark, sf_dir, "part")
    types = surrogate_keys(parts, "p_type", "p_partkey", "category_id").keys.select("p_type", "category_id")
    return parts.join(types, "p_type").select(
        F.col("p_partkey").alias("part_id"), "category_id", F.col("p_type").alias("category_name")
    )


def line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ship day; the parts are derived once per day, after the rows are reduced to days."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trans_date")).distinct()
    return days.withColumns(calendar_columns(F.col("trans_date"))).withColumn("date_id", _day_id("trans_date"))


def line_star(spark: SparkSession, sf_dir: str, customer: bool = False, category: bool = False) -> Star:
    """Star over line items; a dimension that is not asked for is left out."""
    return Star(
        customer=line_customers(spark, sf_dir) if customer else None,
        merchant=line_merchants(spark, sf_dir),
        category=line_categories(spark, sf_dir) if category else None,
        date=line_dates(spark, sf_dir),
        fact=line_fact(spark, sf_dir, customer),
    )


# --- documents ---------------------------------------------------------------------------------


def line_style(pos: Column) -> Column:
    """Every seventh line and some between are headings of levels 1 to 3."""
    at = pos % 7
    return F.when(at == 0, "Heading 1").when(at == 3, "Heading 2").when(at == 5, "Heading 3").otherwise("Normal")


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(documents(spark, sf_dir), style=line_style(F.col("pos")))


# --- vectors -----------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of the same number as payload; a vector without document has a null one."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.struct(F.col("source").alias("section"), F.col("lang").alias("subsection"), "text").alias("payload"),
    )
    return vectors(spark, sf_dir).select("id").join(docs, "id", "left")


LABELS = 10


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark passage; its vector is the mean vector of a label, taken in turn."""
    spread = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = spread.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"])
    # As many values per label as the vectors have dimensions.
    vectors = means.groupBy("label").agg(ordered.alias("vector"))
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    # Labels are 0 to 9; passages of one label have one vector and differ by their words.
    return texts.withColumn("label", F.pmod("query_id", F.lit(LABELS))).join(vectors, "label").drop("label")


# --- questions and answers ---------------------------------------------------------------------


def turn_id(conv_id: str = "conv_id", turn: str = "turn") -> Column:
    """The two numbers as one text, which no other pair shares."""
    return F.concat_ws("-", F.col(conv_id).cast("string"), F.col(turn).cast("string"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, with a route label as a model might write it."""
    kind = F.length("text") % 5
    label = (
        F.when(kind == 0, "data").when(kind == 1, " Document\n").when(kind == 2, "none").when(kind == 3, "other")
    )
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        "conv_id", "turn", turn_id().alias("question_id"), F.col("text").alias("question"), label.alias("label")
    )


def turn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the reply that follows a question as its hits, ranked by word overlap."""
    replies = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    pieces = replies.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.posexplode(sentences(F.col("text"))).alias("at", "text")
    )
    asked = questions(spark, sf_dir).select("conv_id", "turn", "question_id", F.col("question").alias("query"))
    pairs = pieces.join(asked, ["conv_id", "turn"]).select(
        "question_id",
        "query",
        (F.col("at") + 1).alias("dense_rank"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("section"),
        F.when(F.col("at") % 2 == 1, F.concat(F.lit("sentence "), F.col("at").cast("string"))).alias("subsection"),
        "text",
    )
    return rerank(pairs, k=CONTEXT_HITS, query_id="question_id").drop("query")


def turn_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query results of data questions: the event counts by type of the user with the conversation's number."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    asked = questions(spark, sf_dir).filter(route(F.col("question"), F.col("label")) == "data")
    found = asked.select("question_id", F.col("conv_id").alias("user_id")).join(counts, "user_id")
    return found.select(
        "question_id",
        F.col("event_type").alias("row_no"),
        F.to_json(F.struct("event_type", "n")).alias("row_json"),
    )


def turn_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the questions, with the judge's reply as a model might write it."""
    length = F.length("question")
    judge = (
        F.when(length % 6 == 0, "0.8").when(length % 6 == 1, " 1.7 ").when(length % 6 == 2, "-2")
        .when(length % 6 == 3, "n/a").when(length % 6 == 4, F.concat(F.lit("0."), length.cast("string"))).otherwise("")
    )
    kind = route(F.col("question"), F.col("label"))
    return questions(spark, sf_dir).select(
        "question_id",
        F.col("question").alias("answer"),
        kind.alias("answer_type"),
        F.when(kind == "data", F.concat(F.lit("SELECT * FROM events WHERE user_id = "), F.col("conv_id").cast("string"))).alias("sql"),
        (length % 9 == 0).alias("failed"),
        judge.alias("judge_text"),
    )
