"""Every operator bound to the given tables: name -> (spark, sf_dir) -> DataFrame.

Sums are rounded to 2 decimals and ratios to 6, since doubles differ in the last bits by order of
addition; the operators themselves do not round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions import text as TX
from txnlens.functions.measures import METRICS
from txnlens.functions import vector as V
from txnlens.operators import sentences as learned
from txnlens.operators import aggregates, answers, blocks, checks, chunks, embedding, keys, lattice, lsh, profile, search, star
from txnlens.plans import bindings as B
from txnlens.plans import governed, reports
from txnlens.sources import collections as points
from txnlens.schemas import RAW_TXN
from txnlens.session import materialize, new_place
from txnlens.sources import documents, transactions, warehouse

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


METRIC_DIGITS = {"fraud_rate": 6, "total_amount": 2, "fraud_amount": 2, "fraud_share_by_value": 6}

# --- transactions ------------------------------------------------------------------------------


@query
def txn_typed(spark, sf):
    raw = B.event_transactions(spark, sf).select(
        "trans_num",
        F.col("trans_ts").cast("string").alias("trans_date_trans_time"),
        F.concat(F.lit("000"), F.col("cc_num")).alias("cc_num"),
        F.concat(F.lit("0"), F.col("zip")).alias("zip"),
        F.col("dob").cast("string").alias("dob"),
    )
    return transactions.normalize(raw)


@query
def txn_union(spark, sf):
    txn = B.event_transactions(spark, sf).drop("split")
    in_test = F.col("ord") % 4 == 3
    both = transactions.union_splits({"train": txn.filter(~in_test), "test": txn.filter(in_test)})
    return keys.row_ids(both, "ord").select("transaction_id", "trans_num", "split")


@query
def txn_calendar(spark, sf):
    return B.event_features(spark, sf).select(
        "trans_num", "trans_date", "year", "month", "day", "year_month", "day_of_week", "hour", "is_weekend"
    )


@query
def txn_age(spark, sf):
    return rounded(B.event_features(spark, sf).select("trans_num", "age_at_txn_years"), age_at_txn_years=6)


@query
def txn_distance(spark, sf):
    return rounded(B.event_features(spark, sf).select("trans_num", "cust_merch_distance_km"), cust_merch_distance_km=4)


# --- keys and star -----------------------------------------------------------------------------


@query
def surrogate_keys(spark, sf):
    out = keys.surrogate_keys(B.events_with_gaps(spark, sf), "merchant", "ord", "merchant_id").keys
    return out.select("merchant_id", "merchant", "first_ord", "n_rows")


@query
def row_ids(spark, sf):
    orders = B.table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return keys.row_ids(orders, ["o_orderdate", "o_orderkey"])


@query
def fact_keys(spark, sf):
    txn = B.events_with_gaps(spark, sf).select("ord", "trans_num", "merchant")
    merchants = keys.surrogate_keys(txn, "merchant", "ord", "merchant_id")
    return keys.attach_key(txn, merchants, "merchant", "merchant_id", "ord").select("trans_num", "merchant_id")


@query
def dim_customer(spark, sf):
    txn = B.event_features(spark, sf)
    return star.dim_customer(txn, keys.surrogate_keys(txn, "cc_num", "ord", "customer_id"))


@query
def dim_merchant(spark, sf):
    txn = B.events_with_gaps(spark, sf)
    return star.dim_merchant(txn, keys.surrogate_keys(txn, "merchant", "ord", "merchant_id"))


@query
def dim_category(spark, sf):
    return star.dim_category(keys.surrogate_keys(B.event_transactions(spark, sf), "category", "ord", "category_id"))


@query
def dim_date(spark, sf):
    return star.dim_date(keys.surrogate_keys(B.event_features(spark, sf), "trans_date", "ord", "date_id"))


def _event_star(spark, sf):
    return star.build_star(B.event_transactions(spark, sf))


@query
def fact_txn(spark, sf):
    return rounded(_event_star(spark, sf).fact, cust_merch_distance_km=4)


@query
def star_view(spark, sf):
    return rounded(star.star_view(_event_star(spark, sf)), cust_merch_distance_km=4)


# --- aggregates and reports --------------------------------------------------------------------


@query
def agg_daily(spark, sf):
    return rounded(aggregates.agg_fraud(B.line_star(spark, sf), "daily"), **METRIC_DIGITS)


@query
def agg_monthly(spark, sf):
    return rounded(aggregates.agg_fraud(B.line_star(spark, sf), "monthly"), **METRIC_DIGITS)


@query
def agg_merchant(spark, sf):
    return rounded(aggregates.agg_fraud(B.line_star(spark, sf), "merchant"), **METRIC_DIGITS)


@query
def agg_category(spark, sf):
    return rounded(aggregates.agg_fraud(B.line_star(spark, sf, category=True), "category", "part_id"), **METRIC_DIGITS)


@query
def metrics_from_daily(spark, sf):
    tables = B.line_star(spark, sf)
    stored = {"daily": aggregates.agg_fraud(tables, "daily")}
    return rounded(aggregates.metrics(tables, "monthly", stored), **METRIC_DIGITS)


@query
def metrics_by_weekday(spark, sf):
    """From the stored daily aggregate, the smallest that knows days of the week."""
    tables = B.line_star(spark, sf)
    stored = {grain: materialize(aggregates.agg_fraud(tables, grain), grain) for grain in ("daily", "monthly", "merchant")}
    where = {"month": lambda c: c > 3}
    out = lattice.metrics_by(tables, ["year", "day_of_week", "is_weekend"], where, lattice.catalog(stored))
    return rounded(out, **METRIC_DIGITS)


@query
def metrics_by_merchant_hour(spark, sf):
    """No aggregate knows hours, so the star is asked."""
    tables = B.line_star(spark, sf)
    stored = {"merchant": materialize(aggregates.agg_fraud(tables, "merchant"), "merchant")}
    where = {"year": lambda c: c.isin(1993, 1994)}
    return rounded(lattice.metrics_by(tables, ["merchant_name", "hour"], where, lattice.catalog(stored)), **METRIC_DIGITS)


@query
def agg_all(spark, sf):
    """All four aggregates from one scan of the fact, one below the other."""
    tables = B.line_star(spark, sf, category=True)
    found = aggregates.agg_all(tables, {"date": "date_id", "merchant": "merchant_id", "category": "part_id"})
    name = {"daily": F.col("trans_date").cast("string"), "monthly": F.col("year_month"), "merchant": F.col("merchant_name"), "category": F.col("category_name")}
    out = None
    for grain, df in found.items():
        part = df.select(F.lit(grain).alias("grain"), name[grain].alias("name"), *METRICS)
        out = part if out is None else out.unionByName(part)
    return rounded(out, **METRIC_DIGITS)


@query
def fq_monthly_trend(spark, sf):
    return rounded(reports.monthly_trend(aggregates.agg_fraud(B.line_star(spark, sf), "monthly")), fraud_rate=6)


@query
def fq_daily_head(spark, sf):
    return rounded(reports.daily_head(aggregates.agg_fraud(B.line_star(spark, sf), "daily")), **METRIC_DIGITS)


@query
def fq_top_merchants(spark, sf):
    return rounded(reports.top_merchants(aggregates.agg_fraud(B.line_star(spark, sf), "merchant")), fraud_rate=6)


@query
def fq_top_categories(spark, sf):
    tables = B.line_star(spark, sf, category=True)
    return rounded(reports.top_categories(aggregates.agg_fraud(tables, "category", "part_id")), fraud_rate=6)


@query
def fq_entity_ranking(spark, sf):
    tables = B.line_star(spark, sf, category=True)
    ranked = reports.entity_ranking(aggregates.agg_fraud(tables, "merchant"), aggregates.agg_fraud(tables, "category", "part_id"))
    return rounded(ranked, fraud_rate=6)


@query
def fq_last_fraud(spark, sf):
    """Every seventh customer has no dimension row here, so its cases must not take up places."""
    tie_break = ("l_orderkey", "l_linenumber", "part_id", "merchant_id", "amt")
    tables = B.line_star(spark, sf, customer=True)
    tables = replace(tables, customer=tables.customer.filter("customer_id % 7 <> 0"))
    return reports.last_fraud(tables, tie_break=tie_break)


@query
def fq_hourly_fraud(spark, sf):
    return rounded(reports.hourly_fraud(B.event_features(spark, sf)), avg_fraud_amount=6)


# --- SQL, profiles, checks ---------------------------------------------------------------------


@query
def governed_select(spark, sf):
    tables = B.line_star(spark, sf, customer=True)
    for name, df in (("fact_transactions", tables.fact), ("dim_customer", tables.customer), ("dim_merchant", tables.merchant)):
        df.createOrReplaceTempView(name)
    out = governed.run_select(
        spark,
        """
        WITH spend AS (
            SELECT c.job, f.year, m.merchant_name, COUNT(*) AS n_tx, SUM(f.amt) AS amount
            FROM fact_transactions f
            JOIN dim_customer c ON f.customer_id = c.customer_id
            JOIN dim_merchant m ON f.merchant_id = m.merchant_id
            WHERE f.is_fraud = 1
            GROUP BY c.job, f.year, m.merchant_name
        ),
        ranked AS (
            SELECT job, year, merchant_name, n_tx,
                   RANK() OVER (PARTITION BY job, year ORDER BY n_tx DESC, merchant_name) AS place
            FROM spend
        )
        SELECT job, year, COUNT(DISTINCT merchant_name) AS merchants, SUM(n_tx) AS n_tx,
               MAX(CASE WHEN place = 1 THEN n_tx END) AS most
        FROM ranked
        GROUP BY GROUPING SETS ((job, year), (job), ());
        """,
        strict=True,
    )
    return out


@query
def sql_denylist(spark, sf):
    """Statements as a client might send them, one per order."""
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 8
    sql = (
        F.when(kind == 0, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), key, F.lit(";")))
        .when(kind == 1, F.concat(F.lit("  DELETE FROM orders WHERE o_orderkey = "), key, F.lit(" ;; ")))
        .when(kind == 2, F.concat(F.lit("WITH x AS (SELECT "), key, F.lit(") SELECT * FROM x")))
        .when(kind == 3, F.concat(F.lit("drop\ntable t"), key, F.lit(";;\n")))
        .when(kind == 4, F.concat(F.lit("SELECT last_Update FROM t"), key))
        .when(kind == 5, F.concat(F.lit("SELECT last_update , a FROM t"), key))
        .when(kind == 6, F.concat(F.lit("Insert into t values ('"), F.col("o_orderpriority"), F.lit("')")))
        .otherwise(F.concat(F.lit("TRUNCATE t"), key, F.lit(";")))
    )
    stated = o.select("o_orderkey", sql.alias("sql"))
    return stated.select(
        "o_orderkey", governed.cleaned_sql(F.col("sql")).alias("cleaned"), governed.sql_denied(F.col("sql")).alias("denied")
    )


@query
def null_audit(spark, sf):
    txn = B.events_with_gaps(spark, sf)
    return checks.null_audit(txn.select("trans_num", "trans_ts", "merchant", "category", "amt", "is_fraud"))


@query
def result_profile(spark, sf):
    fact = B.line_fact(spark, sf).select("merchant_id", "amt", "is_fraud", "hour", "is_weekend", "trans_ts")
    return rounded(profile.profile(fact), min=6, mean=6, max=6)


@query
def chk_pk(spark, sf):
    return checks.check_pk(B.events_with_gaps(spark, sf), "merchant")


@query
def chk_unique(spark, sf):
    return checks.check_unique(B.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query
def chk_fk(spark, sf):
    """Vectors are fewer than documents, so many documents lack one."""
    docs, vectors = B.table(spark, sf, "documents"), B.table(spark, sf, "embeddings")
    return checks.check_fk(docs.select("doc_id"), "doc_id", vectors, "vec_id")


@query
def chk_width(spark, sf):
    return checks.check_width(B.table(spark, sf, "conversations"), "role", 4).select("conv_id", "turn", "role")


@query
def chk_vectors(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return checks.check_vectors(docs, vectors, 64)


# --- text --------------------------------------------------------------------------------------


@query
def text_clean(spark, sf):
    return B.documents(spark, sf).select("doc_id", TX.clean_text(F.col("text")).alias("text"))


@query
def text_caps(spark, sf):
    lines = B.document_paragraphs(spark, sf)
    return lines.select("doc_id", "pos", TX.is_all_caps(F.col("text")).alias("is_caps"), TX.word_count(F.col("text")).alias("n_words"))


@query
def doc_elements(spark, sf):
    return blocks.elements(B.document_paragraphs(spark, sf))


@query
def doc_blocks(spark, sf):
    """From paragraph rows."""
    return blocks.blocks(blocks.elements(B.document_paragraphs(spark, sf)))


def _blocks(spark, sf):
    return blocks.document_blocks(B.documents(spark, sf), style=B.line_style)


@query
def doc_blocks_inline(spark, sf):
    """From whole documents, one row each."""
    return _blocks(spark, sf)


@query
def block_stats(spark, sf):
    return rounded(profile.text_stats(_blocks(spark, sf)), chars_per_text=6, words_per_text=6)


@query
def sentences(spark, sf):
    docs = B.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(TX.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def sentence_words(spark, sf):
    """How much each word with a stop looks like an abbreviation."""
    scores = learned.abbreviation_scores(materialize(learned.word_counts(B.documents(spark, sf)), "words"))
    return scores.select("word", "n", "n_stop", (F.col("score") >= learned.ABBREVIATION).alias("abbreviation"))


@query
def sentences_learned(spark, sf):
    """Titles and measures are put into the texts, so that there are abbreviations to learn."""
    docs = B.abbreviated(spark, sf)
    found = learned.cut(docs, learned.learn(docs))
    return found.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


@query
def chunks_greedy(spark, sf):
    return chunks.chunks(_blocks(spark, sf), mode="greedy")


@query
def chunks_window(spark, sf):
    return chunks.chunks(_blocks(spark, sf), mode="window")


def _plain_blocks(spark, sf):
    """Without style names most documents are one long block."""
    return blocks.document_blocks(B.documents(spark, sf))


@query
def chunks_greedy_plain(spark, sf):
    return chunks.chunks(_plain_blocks(spark, sf), mode="greedy")


@query
def chunks_window_plain(spark, sf):
    return chunks.chunks(_plain_blocks(spark, sf), mode="window")


@query
def chunk_stats(spark, sf):
    return rounded(profile.text_stats(chunks.chunks(_blocks(spark, sf))), chars_per_text=6, words_per_text=6)


@query
def snippets(spark, sf):
    text = F.col("text")
    return B.documents(spark, sf).select(
        "doc_id",
        TX.snippet(text, 500).alias("context_snippet"),
        TX.snippet(text, 300).alias("evidence_snippet"),
        TX.snippet(text, 200).alias("preview_snippet"),
    )


# --- vectors -----------------------------------------------------------------------------------


@query
def vec_normalize(spark, sf):
    """Components after scaling; the label shifts the values, so lengths differ."""
    e = B.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: (x.cast("double") + F.col("label")).cast("float"))
    unit = e.select("vec_id", V.l2_normalize(scaled).alias("vector"))
    return rounded(unit.select("vec_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double")), x=5)


@query
def embed_texts(spark, sf):
    """The components that are not zero."""
    docs = embedding.embed(B.documents(spark, sf), dim=256).select("doc_id", F.posexplode("vector").alias("pos", "x"))
    return rounded(docs.filter("x <> 0").withColumn("x", F.col("x").cast("double")), x=5)


def letter_counter():
    """Stands in for an encoder: how often each of eight letters occurs in a text."""
    return lambda texts: [[float(t.count(c)) for c in "abcdefgh"] for t in texts]


@query
def embed_model(spark, sf):
    """Vectors of a model that is plugged in."""
    docs = embedding.embed(B.documents(spark, sf), make_encoder=letter_counter)
    flat = docs.select("doc_id", F.posexplode("vector").alias("pos", "x"))
    return rounded(flat.withColumn("x", F.col("x").cast("double")), x=5)


def length_judge():
    """Stands in for a model of pairs: texts about as long as the query score best."""
    return lambda pairs: [1.0 / (1.0 + abs(len(q) - len(t))) for q, t in pairs]


@query
def vec_rerank_model(spark, sf):
    """Hits ranked by a model that is plugged in."""
    queries = materialize(B.label_queries(spark, sf), "asked")
    hits = search.retrieve(queries, B.vectors(spark, sf), k=5, fetch_k=20, scorer=search.pair_scorer(length_judge), payloads=B.payloads(spark, sf))
    return rounded(hits.select("query_id", "id", "rerank_score", "rank"), rerank_score=6)


@query
def vec_topk(spark, sf):
    return rounded(search.search(B.label_queries(spark, sf), B.vectors(spark, sf), k=20), score=6)


@query
def vec_rerank(spark, sf):
    queries = materialize(B.label_queries(spark, sf), "asked")
    hits = search.search(queries, B.vectors(spark, sf), k=20, stored=True)
    hits = search.with_payload(hits, B.payloads(spark, sf), queries.count() * 20)
    hits = hits.join(queries.select("query_id", "query"), "query_id").withColumn("text", F.col("payload.text"))
    ranked = search.rerank(hits)
    return rounded(ranked.select("query_id", "id", "dense_rank", "rerank_score", "rank"), rerank_score=6)


@query
def retrieve(spark, sf):
    hits = search.retrieve(B.label_queries(spark, sf), B.vectors(spark, sf), k=10, payloads=B.payloads(spark, sf))
    out = hits.select("query_id", "id", "score", "payload.section", "payload.subsection", "rerank_score", "rank")
    return rounded(out, score=6, rerank_score=6)


@query
def retrieve_texts(spark, sf):
    """Benchmark passages as questions over the chunks of all documents, with the default encoder."""
    pieces = chunks.chunks(_blocks(spark, sf))
    collection = embedding.embed(pieces, dim=256).select(
        F.col("chunk_id").alias("id"), "vector", F.struct(*points.PAYLOAD_FIELDS).alias("payload")
    )
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = search.embed_and_retrieve(asked, materialize(collection, "points"), 256, k=5)
    return rounded(hits.select("query_id", "id", "score", "rerank_score", "rank"), score=6, rerank_score=6)


@query
def vectors_aligned(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = B.table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("chunk_id"), F.col("embedding").alias("vector"))
    return checks.align_vectors(docs, vectors)


@query
def vec_upsert(spark, sf):
    """New points have even ids, so half of them replace old ones; each comes twice, the later one counts."""
    e = B.table(spark, sf, "embeddings")
    old = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    first = old.select((F.col("id") * 2).alias("id"), "vector", "label", F.col("id").alias("seq"))
    again = first.select("id", F.reverse("vector").alias("vector"), (F.col("label") + 100).alias("label"), (F.col("seq") + 1).alias("seq"))
    out = points.upsert(old, first.unionByName(again), "seq")
    return rounded(out.select("id", "label", V.dot(F.col("vector"), F.col("vector")).alias("norm2"), F.col("vector")[0].cast("double").alias("x0")), norm2=5, x0=6)


@query
def vec_upsert_buckets(spark, sf):
    """The same points as two loads into a collection in buckets."""
    e = B.table(spark, sf, "embeddings")
    old = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label"), F.col("vec_id").alias("seq"))
    first = old.withColumn("id", F.col("id") * 2)
    again = first.select("id", F.reverse("vector").alias("vector"), (F.col("label") + 100).alias("label"), (F.col("seq") + 1).alias("seq"))
    path = _folder(spark, "collection")
    points.create_buckets(spark, path, 64, 16, "id bigint, vector array<float>, label bigint")
    points.upsert_buckets(old, path, "seq")
    points.upsert_buckets(first.unionByName(again), path, "seq")
    out = points.read_buckets(spark, path)
    return rounded(out.select("id", "label", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.col("x").cast("double")), x=6)


@query
def vec_topk_lsh(spark, sf):
    """Found through random projections, so not always all of ``vec_topk``."""
    index = lsh.build_index(B.vectors(spark, sf), seed=1)
    return rounded(lsh.search(index, B.label_queries(spark, sf), k=20), score=6)


@query
def collection_info(spark, sf):
    return points.collection_info(B.table(spark, sf, "embeddings"), "embedding")


# --- files -------------------------------------------------------------------------------------


def _folder(spark, name):
    """A new place in the shared folder, deleted with the stored tables."""
    return new_place(spark, name)


def _raw_files(spark, sf):
    """Events as raw transaction files, one folder per split, with an index column without a name."""
    raw = B.event_transactions(spark, sf).withColumn("trans_date_trans_time", F.date_format("trans_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    raw = raw.withColumn("", F.col("ord"))
    paths = {}
    for name in ("train", "test"):
        paths[name] = _folder(spark, f"raw-{name}")
        raw.filter(F.col("split") == name).select(F.col("``"), *RAW_TXN).write.option("header", True).option("escape", '"').csv(paths[name])
    return paths


@query
def csv_transactions(spark, sf):
    """Written as CSV and read back: types, missing values, ids without leading zeros, no index column."""
    out = transactions.read_transactions(spark, _raw_files(spark, sf))
    return out.drop("ord").withColumn("dob", F.col("dob").cast("string"))


@query
def chunk_files(spark, sf):
    """Chunks written as JSON Lines and read back."""
    path = _folder(spark, "chunks")
    documents.write_chunks(chunks.chunks(_blocks(spark, sf)), path)
    return documents.read_chunks(spark, path)


def _small_star(spark, sf):
    return star.build_star(B.events_with_gaps(spark, sf))


def _stored(spark, sf):
    root = _folder(spark, "warehouse")
    warehouse.save_star(_small_star(spark, sf), root)
    loaded = warehouse.load_star(spark, root)
    warehouse.refresh_aggregates(loaded, root)
    return root, loaded


def _two_loads(spark, sf):
    """Even events saved as a star, odd ones added to it."""
    root = _folder(spark, "warehouse")
    txn = B.events_with_gaps(spark, sf)
    warehouse.save_star(star.build_star(txn.filter("ord % 2 = 0")), root)
    warehouse.append_transactions(txn.filter("ord % 2 = 1"), root, rebalance=False)
    return warehouse.load_star(spark, root)


@query
def warehouse_fact(spark, sf):
    """The fact after two loads, all its columns."""
    return rounded(_two_loads(spark, sf).fact, cust_merch_distance_km=4)


@query
def warehouse_continued(spark, sf):
    """The dimensions after two loads: keys of the first stay, those of the second go on."""
    loaded = _two_loads(spark, sf)
    key = {"customer": "cc_num", "merchant": "merchant_name", "category": "category_name", "date": "trans_date"}
    out = None
    for name, c in key.items():
        part = loaded.dim(name).select(F.lit(name).alias("dimension"), F.col(f"{name}_id").alias("id"), F.col(c).cast("string").alias("name"))
        out = part if out is None else out.unionByName(part)
    used = loaded.fact.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n_facts"))
    used = used.select(F.lit("merchant").alias("dimension"), F.col("merchant_id").alias("id"), "n_facts")
    return out.join(used, ["dimension", "id"], "left")


@query
def warehouse_daily(spark, sf):
    """The daily aggregate, refreshed in the warehouse and loaded."""
    root, _ = _stored(spark, sf)
    return rounded(warehouse.load_aggregates(spark, root)["daily"], **METRIC_DIGITS)


def _restored(spark, sf):
    root, loaded = _stored(spark, sf)
    path, restored = _folder(spark, "snapshot"), _folder(spark, "restored")
    warehouse.export_snapshot(warehouse.relations(loaded, warehouse.load_aggregates(spark, root)), path)
    return warehouse.restore_snapshot(spark, path, restored)


@query
def snapshot_merchants(spark, sf):
    """All relations exported, restored elsewhere, and read there."""
    return rounded(_restored(spark, sf)["agg_merchant_fraud"], **METRIC_DIGITS)


@query
def snapshot_counts(spark, sf):
    """Rows of each of the nine relations after a restore, and the sum of a column of each."""
    measured = {
        "dim_customer": "city_pop", "dim_merchant": "merchant_id", "dim_category": "category_id", "dim_date": "day", "fact_transactions": "unix_time",
        "agg_daily_fraud": "total_tx", "agg_monthly_fraud": "fraud_tx", "agg_merchant_fraud": "total_tx", "agg_category_fraud": "fraud_tx",
    }
    tables, out = _restored(spark, sf), None
    for name, column in measured.items():
        part = tables[name].agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(column).cast("bigint")).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def collection_files(spark, sf):
    """A collection created for its dimension, filled by an upsert, saved and read back."""
    e = B.table(spark, sf, "embeddings")
    payload = F.struct(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("subsection"),
        F.lit(0).alias("block_index"), F.col("label").cast("int").alias("chunk_index"), F.lit("t").alias("text"),
    )
    new = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload"), F.lit(1).alias("seq"))
    empty = points.create_collection(spark, _folder(spark, "collection"), 64)
    path = _folder(spark, "collection")
    points.save_collection(points.upsert(empty, new, "seq"), path)
    out = points.read_collection(spark, path)
    flat = out.select("id", F.col("payload.chunk_index").alias("label"), F.size("vector").alias("dim"), F.posexplode("vector").alias("pos", "x"))
    return rounded(flat.withColumn("x", F.col("x").cast("double")), x=6)


@query
def vector_files(spark, sf):
    """Vectors stored apart from the texts."""
    path = _folder(spark, "vectors")
    points.save_vectors(B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), path)
    flat = spark.read.parquet(path).select("chunk_id", F.posexplode("vector").alias("pos", "x"))
    return rounded(flat.withColumn("x", F.col("x").cast("double")), x=6)


@query
def select_capped(spark, sf):
    """A row cap on request; the statement orders the rows."""
    warehouse.register_views({"dim_customer": B.line_customers(spark, sf)})
    return governed.run_select(spark, "SELECT customer_id, job FROM dim_customer ORDER BY customer_id DESC;", limit=25, strict=True)


@query
def chk_smallint(spark, sf):
    return checks.check_smallint(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


# --- questions ---------------------------------------------------------------------------------


@query
def qa_route(spark, sf):
    q = B.questions(spark, sf)
    return q.select(
        "question_id",
        answers.route(F.col("question"), F.col("label")).alias("route"),
        answers.route(F.col("question")).alias("route_by_words"),
    )


@query
def qa_branches(spark, sf):
    """Each branch adds what only it has: SQL for data, the length of the query text for documents."""
    q = B.questions(spark, sf)
    routed = q.select("question_id", "conv_id", "question", answers.route(F.col("question"), F.col("label")).alias("route"))
    branches = answers.by_route(routed)
    sql = F.concat(F.lit("SELECT * FROM events WHERE user_id = "), F.col("conv_id").cast("string"))
    branches["data"] = branches["data"].withColumn("sql", sql)
    branches["document"] = branches["document"].withColumn("n_terms", F.size(TX.terms(F.col("question"))))
    return answers.recombine(branches).select("question_id", "route", "sql", "n_terms")


@query
def chat_history(spark, sf):
    return answers.chat_history(B.table(spark, sf, "conversations"))


@query
def qa_context(spark, sf):
    return answers.context(B.turn_hits(spark, sf))


@query
def qa_evidence(spark, sf):
    return answers.evidence(B.turn_hits(spark, sf))


@query
def qa_data_evidence(spark, sf):
    """Data questions over the events of the user with the conversation's number, as result rows."""
    asked = B.questions(spark, sf).filter(answers.route(F.col("question"), F.col("label")) == "data")
    events = B.table(spark, sf, "events").select("user_id", "value", F.hour("ts").alias("hour"))
    results = asked.select("question_id", F.col("conv_id").alias("user_id")).join(events, "user_id")
    return rounded(answers.data_evidence(results, ["value", "hour"]), min=6, mean=6, max=6)


def _scored(spark, sf):
    return answers.scored(B.turn_answers(spark, sf), B.turn_results(spark, sf), B.turn_hits(spark, sf))


@query
def qa_base_score(spark, sf):
    out = _scored(spark, sf).select("question_id", "answer_type", "n_rows", "n_hits", "base_score")
    return rounded(out, base_score=6)


@query
def qa_final_score(spark, sf):
    return rounded(_scored(spark, sf).select("question_id", "quality_score"), quality_score=6)


@query
def qa_answers(spark, sf):
    """Answer records, the nested sources flattened: one row per source, or one without source."""
    hits = B.turn_hits(spark, sf)
    records = answers.answer_records(_scored(spark, sf), hits)
    flat = records.select("*", F.posexplode_outer("chunks").alias("source_no", "source")).drop("chunks")
    return rounded(
        flat.select(
            "question_id", "answer", "answer_type", "quality_score", "sql", "source_type", "n_rows", "source_no",
            "source.section", "source.subsection", "source.snippet", "source.rerank_score",
        ),
        quality_score=6,
        rerank_score=6,
    )


@query
def qa_answer_rows(spark, sf):
    return answers.answer_rows(_scored(spark, sf), B.turn_results(spark, sf))
