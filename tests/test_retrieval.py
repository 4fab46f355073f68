import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from txnlens.functions import vector as V
from txnlens.operators import answers, checks, embedding, lsh, search
from txnlens.plans import governed
from txnlens.session import materialize
from txnlens.sources import collections, versions


def points(spark, n=500, dim=8, seed=1, ids="long"):
    rng = np.random.default_rng(seed)
    data = [[round(float(x), 2) for x in rng.normal(size=dim)] for _ in range(n)]
    for i in range(0, n - 1, 10):  # ties
        data[i + 1] = data[i]
    data[7] = [0.0] * dim
    rows_ = [(i if ids == "long" else f"p{i:04d}", v) for i, v in enumerate(data)]
    return rows_, spark.createDataFrame(rows_, f"id {'long' if ids == 'long' else 'string'}, vector array<float>")


def brute_force(queries, data, k):
    out = set()
    for q, v in queries:
        scored = []
        for i, p in data:
            a, b = np.array(v, np.float32).astype(float), np.array(p, np.float32).astype(float)
            length = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if length > 0:
                scored.append((-round(float((a * b).sum() / length), 7), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("ids", ["long", "string"])
@pytest.mark.parametrize("block_bytes, broadcast_bytes", [(64, 1 << 20), (200, 0), (1 << 20, 1 << 20)])
def test_search_is_exact(spark, ids, block_bytes, broadcast_bytes):
    """Many partitions, small batches, ties, a zero vector, and queries in one or many blocks."""
    data, df = points(spark, ids=ids)
    queries = [(q, data[q * 9][1]) for q in range(12) if q * 9 != 7]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<float>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = search.search(qdf, df.repartition(5), 6, block_bytes=block_bytes, broadcast_bytes=broadcast_bytes)
        assert {(r["query_id"], r["id"], r["dense_rank"]) for r in got.collect()} == brute_force(queries, data, 6)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_search_edges(spark):
    data, df = points(spark, n=20)
    none = spark.createDataFrame([], "query_id long, vector array<float>")
    assert search.search(none, df, 3).count() == 0
    zero = spark.createDataFrame([(1, [0.0] * 8), (2, None)], "query_id long, vector array<float>")
    assert search.search(zero, df, 3).count() == 0
    one = spark.createDataFrame([(1, data[0][1])], "query_id long, vector array<float>")
    assert search.search(one, df, 100).count() == 19  # all but the zero vector
    assert search.search(one, df.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="queries 8"):
        search.search(one, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>"), 3).collect()
    with pytest.raises(ValueError):
        search.search(one, df, 0)


def test_search_shuffles_only_candidates(spark):
    data, df = points(spark)
    qdf = spark.createDataFrame([(1, data[0][1])], "query_id long, vector array<float>")
    plan = search.search(qdf, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow") and "Cartesian" not in plan and "NestedLoop" not in plan


def test_many_queries_meet_the_points_in_a_grid(spark, monkeypatch):
    """Beyond the broadcast limit each task takes one tile, whatever the number of queries or points."""
    from types import SimpleNamespace

    data, df = points(spark, n=600)
    queries = [(q, data[q][1]) for q in range(60) if q != 7]
    qdf = spark.createDataFrame(queries, "query_id long, vector array<float>")
    sizes, tiles = [], search._tiles

    def seen(packed, blocks, n_rows, n_columns):
        cells = tiles(packed, blocks, n_rows, n_columns)
        count = cells.applyInArrow(
            lambda a, b: pa.table([pa.array([sum(map(len, a["asked"].to_pylist()))]), pa.array([sum(map(len, b["points"].to_pylist()))])], ["q", "p"]), "q long, p long"
        )
        sizes.append(SimpleNamespace(rows=n_rows, columns=n_columns, cells=[tuple(r) for r in count.collect()]))
        return cells

    monkeypatch.setattr(search, "_tiles", seen)
    got = search.search(qdf, df.repartition(7), 6, block_bytes=256, broadcast_bytes=1024, tile_bytes=8192)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert {(r["query_id"], r["id"], r["dense_rank"]) for r in got.collect()} == brute_force(queries, data, 6)
    grid = sizes[0]
    assert grid.rows == 4 and grid.columns == 5 and len(grid.cells) == grid.rows * grid.columns
    # 59 queries and 600 points of 64 bytes: no tile has them all, and all tiles together have each point once a row.
    assert max(q for q, _ in grid.cells) < 59 * 64 and max(p for _, p in grid.cells) <= 2 * 8192
    assert sum(p for _, p in grid.cells) <= grid.rows * 600 * 64


def test_models_of_pairs_get_bounded_batches(spark):
    def make():
        def model(pairs):
            assert 0 < len(pairs) <= 7 and all(isinstance(x, str) for p in pairs for x in p)
            return [len(t) - len(q) / 100 for q, t in pairs]

        return model

    hits = spark.createDataFrame([(q, i, i, "q" * q, None if i == 3 else "t" * (i * 7 % 50)) for q in range(3) for i in range(1, 41)], "query_id long, id long, dense_rank int, query string, text string").repartition(3)
    got = search.rerank(hits, scorer=search.pair_scorer(make, 7)).orderBy("query_id", "rank").collect()
    want = sorted(((q, -(0 if i == 3 else i * 7 % 50) + q / 100, i) for q in range(3) for i in range(1, 41)))
    assert [(r["query_id"], r["id"]) for r in got] == [(q, i) for q, _, i in want]
    with pytest.raises(Exception, match="gave 1 scores"):
        search.rerank(hits, scorer=search.pair_scorer(lambda: lambda pairs: [1.0], 7)).collect()
    with pytest.raises(ValueError):
        search.pair_scorer(make, 0)


def clustered(spark, n=6000, width=32, seed=4):
    """Points around 60 centres, with an exact copy of one of them many times."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, width))
    data = centres[rng.integers(0, 60, n)] + 0.4 * rng.standard_normal((n, width))
    data[-500:] = data[0]
    return spark.createDataFrame([(i, v) for i, v in enumerate(data.astype(float).tolist())], "id long, vector array<float>").repartition(4)


def test_lsh_search_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(lsh, "HOT_POINTS", 100)  # many buckets are dealt into parts
    df = materialize(clustered(spark), "points")
    index = lsh.build_index(df)
    assert index.bits == 7 and index.hot.count() > 5
    parts = index.entries.groupBy("table", "bucket", "part").count().agg(F.max("count")).first()[0]
    assert parts <= 200 and index.entries.count() == 12 * 6000
    queries = df.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    measured = lsh.recall(index, queries, 10).agg(F.avg("recall"), F.count("recall")).first()
    assert measured[0] >= 0.95 and measured[1] == 60
    hits = lsh.search(index, queries, 10)
    exact = {(r["query_id"], r["id"]): r["score"] for r in search.search(queries, df, 700).collect()}
    for r in hits.collect():
        assert r["score"] == pytest.approx(exact[r["query_id"], r["id"]]) if (r["query_id"], r["id"]) in exact else r["score"] < 1
    # It looks at a part of the points only.
    assert lsh.candidates(index, queries).count() < 0.45 * 60 * 6000
    few = lsh.candidates(index, queries, probes=1)
    assert few.count() < lsh.candidates(index, queries, probes=8).count() and few.groupBy("query_id", "id").count().filter("count > 1").count() == 0


def test_lsh_edges(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, vector array<float>")
    assert lsh.search(lsh.build_index(none), asked.filter("query_id = 'n'"), 3).count() == 0
    few = spark.createDataFrame([("a", [2.0, 0.1]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.9, 0.1])], "id string, vector array<float>")
    assert [(r["query_id"], r["id"], r["dense_rank"]) for r in lsh.search(lsh.build_index(few, bits=3), asked, 3, probes=8).orderBy("dense_rank").collect()] == [("q", "a", 1), ("q", "d", 2)]
    with pytest.raises(ValueError):
        lsh.search(lsh.build_index(few), asked, 0)
    with pytest.raises(Exception, match="values instead of"):
        lsh.search(lsh.build_index(few), spark.createDataFrame([("q", [1.0])], "query_id string, vector array<float>"), 1).collect()


def test_probes_come_in_order_of_distance():
    side = np.array([0.5, -0.1, 2.0, -0.7])
    found = list(lsh._probed(side, 16))
    cost = lambda b: sum(side[i] ** 2 for i in range(4) if (b >> i & 1) != (side[i] > 0))
    assert sorted(found) == list(range(16)) and found[0] == 0b0101
    assert [cost(b) for b in found] == sorted(cost(b) for b in found)
    assert list(lsh._probed(side, 5)) == found[:5] and len(list(lsh._probed(side[:1], 9))) == 2


def test_upsert_replaces_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = "id long, vector array<float>, payload string"
    collections.create_buckets(spark, path, 2, 8, "id bigint, vector array<float>, payload string")
    assert collections.read_buckets(spark, path).count() == 0 and collections.dimension(collections.read_buckets(spark, path)) == 2
    load = lambda rows_: spark.createDataFrame(rows_, schema).withColumn("seq", F.lit(1))
    touched = collections.upsert_buckets(load([(i, [float(i), 1.0], "old") for i in range(100)]), path, "seq")
    assert touched == list(range(8))

    def files(bucket):
        return sorted(collections.read_buckets(spark, path, [bucket]).inputFiles())

    before = {b: files(b) for b in range(8)}
    names = load([(3, [9.0, 9.0], "new"), (3, [9.0, 9.0], "new"), (1000, [1.0, 2.0], "new")])
    touched = collections.upsert_buckets(names, path, "seq")
    assert 1 <= len(touched) <= 2
    for b in range(8):
        assert (files(b) == before[b]) == (b not in touched)
    got = {r["id"]: (r["vector"], r["payload"]) for r in collections.read_buckets(spark, path).collect()}
    assert len(got) == 101 and got[3] == ([9.0, 9.0], "new") and got[1000][1] == "new" and got[4] == ([4.0, 1.0], "old")
    assert collections.upsert_buckets(load([]), path, "seq") == []
    version = versions.current(spark, path).number
    for bad, message in (([(1, [1.0], "x")], "has not 2 values"), ([(None, [1.0, 1.0], "x")], "has no id")):
        with pytest.raises(Exception, match=message):
            collections.upsert_buckets(load(bad), path, "seq")
    assert versions.current(spark, path).number == version and collections.read_buckets(spark, path).count() == 101
    assert versions.drop_unused(spark, path, keep=1) >= 1 and collections.read_buckets(spark, path).count() == 101
    with pytest.raises(ValueError, match="no collection"):
        collections.read_buckets(spark, str(tmp_path / "nothing"))


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0])], "k int, a array<float>, b array<float>")
    got = {r["k"]: (r["u"], r["c"]) for r in df.select("k", V.l2_normalize(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[1] == (pytest.approx([0.6, 0.8]), pytest.approx(0.96))
    assert got[2] == (None, None) and got[3] == (None, None)


def test_default_encoder(spark):
    df = spark.createDataFrame([(1, "card fraud card"), (2, "fraud card card"), (3, "Other things"), (4, None)], "k int, text string")
    got = {r["k"]: np.array(r["vector"]) for r in embedding.embed(df, dim=512).collect()}
    assert all(len(v) == 512 and np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5) for v in got.values())
    assert np.allclose(got[1], got[2])
    # Words: passage, card (twice), fraud; the other text shares only the role word.
    assert got[1] @ got[3] == pytest.approx(1 / (6**0.5 * 3**0.5), abs=1e-5)
    query = embedding.embed(df.filter("k = 1"), role="query", dim=512).first()["vector"]
    assert np.array(query) @ got[1] == pytest.approx(5 / 6, abs=1e-5)
    with pytest.raises(ValueError):
        embedding.embed(df, role="other")


def test_plugged_encoder(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 3
            return np.array([[len(t), t.startswith("query: ")] for t in texts], dtype=np.float64)

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "k int, text string").coalesce(1)
    got = {r["k"]: r["vector"] for r in embedding.embed(df, role="query", make_encoder=make, batch_size=3).collect()}
    for k, v in got.items():
        want = np.array([7 + k, 1.0])
        assert v == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)


def test_rerank_and_retrieve(spark):
    coll = spark.createDataFrame(
        [("a", [1.0, 0.0], "alpha beta"), ("b", [0.9, 0.1], "gamma"), ("c", [0.8, 0.3], "alpha beta gamma"), ("d", [0.0, 1.0], "alpha beta gamma delta")],
        "id string, vector array<float>, text string",
    ).select("id", "vector", F.struct("text").alias("payload"))
    q = spark.createDataFrame([(1, "Gamma alpha, beta!", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    dense = search.retrieve(q, coll, 3, use_reranker=False).orderBy("rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in dense] == [("a", None), ("b", None), ("c", None)]
    ranked = search.retrieve(q, coll, 3).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == ["c", "a", "b"] and ranked[0]["rerank_score"] == 1.0
    wider = search.retrieve(q, coll, 2, fetch_k=4).orderBy("rank").collect()
    assert [r["id"] for r in wider] == ["c", "d"]  # equal scores keep the dense order
    own = search.retrieve(q, coll, 3, scorer=lambda query, text: -F.length(text)).orderBy("rank").collect()
    assert [r["id"] for r in own] == ["b", "a", "c"]


def test_collection(spark, tmp_path):
    empty = collections.create_collection(spark, str(tmp_path / "c"), 2)
    assert collections.dimension(empty) == 2
    assert rows(collections.collection_info(empty)) == [(0, None, None)]
    chunk = spark.createDataFrame([("x", "S", None, 0, 0, "t1"), ("y", None, None, 0, 1, "t2")], "chunk_id string, section string, subsection string, block_index int, chunk_index int, text string")
    vec = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, vector array<float>")
    pts = collections.points(chunk, vec, 2)
    assert pts.schema.simpleString() == empty.schema.simpleString()
    full = collections.upsert(empty, pts.withColumn("seq", F.lit(1)), "seq")
    collections.save_collection(full, str(tmp_path / "c2"))
    assert rows(collections.collection_info(collections.read_collection(spark, str(tmp_path / "c2")))) == [(2, 2, 2)]
    again = collections.read_collection(spark, str(tmp_path / "c2"))
    assert collections.dimension(again) == 2
    narrow = pts.select("id", F.array(F.lit(1.0).cast("float")).alias("vector"), "payload", F.lit(2).alias("seq"))
    for old in (empty, again):
        with pytest.raises(Exception, match="has not 2 values"):
            collections.upsert(old, narrow, "seq")
    collections.save_vectors(vec, str(tmp_path / "v"))
    assert rows(spark.read.parquet(str(tmp_path / "v"))) == rows(vec)
    with pytest.raises(ValueError, match="do not match"):
        collections.points(chunk, vec.limit(1), 2)
    with pytest.raises(ValueError, match="do not match"):
        collections.points(chunk, vec, 3)


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<float>")
    new = spark.createDataFrame([("b", [3.0], 1), ("b", [5.0], 3), ("b", [4.0], 2), ("c", [6.0], 4)], "id string, vector array<float>, seq int")
    got = collections.upsert(old, new, "seq")
    assert rows(got) == [("a", [1.0]), ("b", [5.0]), ("c", [6.0])]
    assert rows(collections.upsert(got, new, "seq")) == rows(got)


def test_alignment(spark):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    v = spark.createDataFrame([("b", [1.0]), ("c", [1.0, 2.0])], "chunk_id string, vector array<float>")
    assert rows(checks.align_vectors(c, v)) == [("a", True, False, None), ("b", True, True, 1), ("c", False, True, 2)]
    assert rows(checks.check_vectors(c, v, 1), "chunk_id") == [("a",), ("c",)]


# --- questions ---------------------------------------------------------------------------------


def test_route(spark):
    cases = [
        ("What is skimming?", None, "document"), ("Merchant collusion?", None, "data"), ("What is an ACCOUNT?", None, "data"), ("Hello", None, "none"),
        ("Hello", " Data\n", "data"), ("Monthly trend", "none", "none"), ("Hello", "sql", "none"), ("Use of a white paper", "", "document"),
    ]
    df = spark.createDataFrame(cases, "q string, l string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", answers.route(F.col("q"), F.col("l"))).collect())


def test_branches(spark):
    df = spark.createDataFrame([(1, "data"), (2, "document"), (3, None), (4, "other"), (5, "none")], "question_id long, route string")
    parts = answers.by_route(df)
    assert {name: [r[0] for r in rows(part)] for name, part in parts.items()} == {"data": [1], "document": [2], "none": [3, 4, 5]}
    parts["data"] = parts["data"].withColumn("sql", F.lit("SELECT 1"))
    assert rows(answers.recombine(parts), "question_id", "sql") == [(1, "SELECT 1"), (2, None), (3, None), (4, None), (5, None)]


def test_chat_history(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", None), (3, 1, "user", "x"), (3, 2, "tool", "y"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert rows(answers.chat_history(df), "conv_id", "turn") == [(1, 1), (1, 2), (2, 0), (2, 1), (3, 1)]
    assert (1, 3) in rows(answers.chat_history(df, exclude_last_user=False), "conv_id", "turn")


def hits(spark):
    return spark.createDataFrame(
        [(1, 1, "S", None, "one\ntwo", 0.5), (1, 2, None, "T", "x" * 600, None), (1, 3, "U", "V", "three", 1.0)] + [(2, i, "S", "T", f"h{i}", 0.0) for i in range(1, 8)],
        "question_id long, rank int, section string, subsection string, text string, rerank_score double",
    )


def test_context_and_evidence(spark):
    context = dict(rows(answers.context(hits(spark))))
    assert context[1] == (
        "[1] Section: S | Subsection: None\none two\n\n[2] Section: None | Subsection: T\n" + "x" * 500 + "\n\n[3] Section: U | Subsection: V\nthree\n"
    )
    assert dict(rows(answers.evidence(hits(spark))))[1] == "one two\n\n" + "x" * 300


def test_answer_records(spark):
    given = spark.createDataFrame(
        [(1, "A", "document", None, None, "0.9"), (2, "B", "document", None, None, None), (3, None, "data", "SELECT 1", False, "bad"), (4, "D", None, None, None, "0.1"), (5, "E", "data", "SELECT x", True, None), (6, "F", "document", None, None, None)],
        "question_id long, answer string, answer_type string, sql string, failed boolean, judge_text string",
    )
    results = spark.createDataFrame([(3, i, f'{{"n":{i}}}') for i in range(3)] + [(1, 0, "{}")], "question_id long, row_no int, row_json string")
    done = answers.scored(given, results, hits(spark))
    got = {r["question_id"]: r for r in answers.answer_records(done, hits(spark)).collect()}
    logistic = lambda x: 1 / (1 + 2.71828**-x)
    assert got[1]["quality_score"] == pytest.approx((0.6 + 0.3 * logistic(0.5) + 0.9) / 2)
    assert got[1]["source_type"] == "document_chunks" and [c["snippet"] for c in got[1]["chunks"]] == ["one\ntwo", "x" * 600, "three"]
    assert len(got[2]["chunks"]) == 5 and got[2]["quality_score"] == pytest.approx(0.75)
    assert (got[3]["answer"], got[3]["n_rows"], got[3]["chunks"], got[3]["quality_score"]) == ("", 3, None, pytest.approx(0.75))
    assert (got[4]["answer_type"], got[4]["source_type"], got[4]["quality_score"]) == ("unknown", None, pytest.approx(0.2))
    assert (got[5]["n_rows"], got[5]["quality_score"]) == (0, pytest.approx(0.3))
    assert got[6]["chunks"] == []
    assert rows(answers.answer_rows(done, results), "question_id", "row_no") == [(3, 0), (3, 1), (3, 2)]


# --- governed SQL ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "sql, denied", [("SELECT 1;;", False), ("WITH x AS (SELECT 1) SELECT * FROM x", False), ("DROP TABLE t", True), ("drop\ntable t", False), ("select last_update from t", True), ("select last_updated from t", False), ("select last_update , a from t", True), (" Truncate t;", True), ("TRUNCATE;", False)]
)
def test_deny_list(spark, sql, denied):
    row = spark.createDataFrame([(sql,)], "s string").select(governed.sql_denied(F.col("s")).alias("d"), governed.cleaned_sql(F.col("s")).alias("c")).first()
    assert row["d"] is denied and row["c"] == sql.strip().rstrip(";")
    if denied:
        with pytest.raises(ValueError):
            governed.checked_sql(sql)
    else:
        assert governed.checked_sql(sql) == row["c"]


def test_search_plan_does_not_grow_with_the_queries(spark):
    points = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(8)]).alias("vector"))

    def nodes(n):
        asked = points.limit(n).select(F.col("id").alias("query_id"), "vector")
        plan = search.search(asked, points, 3, block_bytes=640)._jdf.queryExecution().executedPlan().toString()
        return [line.split("(")[0].split("[")[0].strip() for line in plan.splitlines()]

    assert nodes(5) == nodes(200)


def test_upsert_ties(spark):
    """One point per id comes out, the same whatever the order of the rows."""
    old = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    tied = [("b", [3.0], 1), ("b", [5.0], 1), ("b", [5.0], 1), ("a", [7.0], 1)]
    results = [rows(collections.upsert(old, spark.createDataFrame(t, "id string, vector array<float>, seq int"), "seq")) for t in (tied, tied[::-1])]
    assert results[0] == results[1] and [r[0] for r in results[0]] == ["a", "b"]


def test_strict_select_judges_the_parsed_statement(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("allowed_rows")
    spark.range(3).createOrReplaceTempView("other_rows")
    spark.range(3).write.parquet(str(tmp_path / "t"))
    run = lambda sql: governed.run_select(spark, sql, strict=True, relations=["allowed_rows"])
    good = [
        "SELECT * FROM allowed_rows;", "WITH x AS (SELECT id FROM allowed_rows), y AS (SELECT * FROM x) SELECT id FROM y",
        "SELECT id FROM Allowed_Rows WHERE id IN (SELECT max(id) FROM allowed_rows)", "SELECT id, COUNT(*) FROM allowed_rows GROUP BY GROUPING SETS ((id), ())",
    ]
    for sql in good:
        run(sql).count()
    bad = [
        "WITH x AS (SELECT 1 AS id) INSERT\nINTO allowed_rows SELECT * FROM x", "SHOW TABLES", "SELECT * FROM other_rows", "SET spark.x=1", "DROP\nVIEW allowed_rows",
        "SELECT * FROM allowed_rows WHERE id IN (SELECT id FROM other_rows)", f"SELECT * FROM parquet.`{tmp_path}/t`", "SELECT * FROM range(5)",
        "SELECT java_method('java.lang.System', 'nanoTime')", "SELECT reflect('java.lang.System', 'nanoTime') FROM allowed_rows", "EXPLAIN SELECT * FROM allowed_rows", "CACHE TABLE allowed_rows",
        "SELECT (SELECT max(id) FROM other_rows)", "CREATE\nTABLE t AS SELECT 1", "SELECT * FROM allowed_rows UNION SELECT * FROM other_rows",
    ]
    for sql in bad:
        with pytest.raises(ValueError):
            run(sql)


def test_data_evidence(spark):
    found = spark.createDataFrame([(1, 2.0, None), (1, 4.0, 5), (2, None, 1)], "question_id long, amt double, n int")
    got = answers.data_evidence(found, ["amt", "n"])
    assert rows(got) == [(1, "amt", 2, 2.0, 3.0, 4.0), (1, "n", 2, 5.0, 5.0, 5.0), (2, "amt", 1, None, None, None), (2, "n", 1, 1.0, 1.0, 1.0)]
    text = {r[0]: r[1] for r in answers.data_evidence_text(got).collect()}
    assert text[1] == "Rows: 2\namt: min=2.0000, mean=3.0000, max=4.0000\nn: min=5.0000, mean=5.0000, max=5.0000"
    assert "amt: min=none" in text[2]


def test_run_select(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    assert governed.run_select(spark, "SELECT * FROM numbers;").count() == 100
    assert governed.run_select(spark, "SELECT * FROM numbers", limit=7).count() == 7
    with pytest.raises(ValueError, match="only queries"):
        governed.run_select(spark, "SHOW TABLES", strict=True)


def test_shared_dir_is_required_on_a_cluster(spark):
    from txnlens import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Other:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("__", "."): v for k, v in conf.items()})
            self.conf.set = self.conf.__setitem__

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            session.shared_dir(Other(spark__master=master))
    assert session.shared_dir(Other(spark__master="yarn", spark__checkpoint__dir="hdfs:///shared/")) == "hdfs:///shared"
    alone = Other(spark__master="local[2]", spark__sql__warehouse__dir="file:/w")
    assert session.shared_dir(alone) == session.shared_dir(alone) == "file:/w/txnlens-stored"


def test_stored_tables_are_released(spark):
    from pathlib import Path

    from txnlens import session

    session.release(spark)
    kept = session.materialize(spark.range(10), "mine")
    folder = Path(session.shared_dir(spark).removeprefix("file:")) / "txnlens"
    assert kept.count() == 10 and list(folder.glob("mine-*"))
    assert session.release(spark) == 1 and not list(folder.iterdir()) and session.release(spark) == 0


def test_question_ids_survive_long_conversations(spark):
    from txnlens.plans.bindings import turn_id

    turns = spark.createDataFrame([(1, 1000), (2, 0), (1, 11), (11, 1)], "conv_id long, turn long")
    assert turns.select(turn_id().alias("id")).distinct().count() == 4
