"""The stages on the smallest given tables, each judged on its own input."""

import corpus_pipeline
import pytest
from corpus import SCHEMA, frame
from pyspark.sql import functions as F
from test_exact import joined
from test_native import many_leaves, without_templates

from txnlens.llm.decontaminate import normal
from txnlens.operators.joins import table_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read again as in production."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert after.count() <= before.count()


def test_toxic_documents_go(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    _, before, after = stages[0]
    kept = {i for i, _ in texts(after)}
    clean = [i for i, _ in texts(before) if labels.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)  # learned from a dozen toxic rows


def test_lines_go(stages):
    _, before, after = stages[1]
    assert sorted(texts(after)) == sorted(without_templates(texts(before), 3, 6))


def test_lines_send_few_bytes(spark, monkeypatch):
    """All that the stage sends from the driver is a few bytes a leaf."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(table_bytes(df)) or broadcast(df))
    rows = many_leaves()
    after = texts(corpus_pipeline.line_dedup(spark, frame(spark, rows), SF))
    assert sent and sum(sent) < 100_000
    assert sorted(after) == sorted(without_templates(rows, 3, 6))


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = texts(before)
    low = joined(rows, 5, 80)
    assert sorted(texts(after)) == sorted((i, t) for i, t in rows if low[i] == i)


def test_no_item_is_left(spark, stages):
    _, before, after = stages[3]
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in texts(before) if not any(x in normal(t) for x in items)}
    kept = {i for i, _ in texts(after)}
    assert kept <= clean and len(clean - kept) <= 0.02 * len(clean)


def test_mix(stages):
    _, before, after = stages[4]
    assert after.columns == [*before.columns, "copy"]
    n = before.count()
    assert abs(after.count() - n) < 5 * n**0.5
    assert {i for i, _ in texts(after)} <= {i for i, _ in texts(before)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_schema_name():
    assert "doc_id long" in SCHEMA
