import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from txnlens.operators import blocks, chunks, profile
from txnlens.sources import documents

STYLES = ["Normal", "Normal", "Normal", "Heading 1", "Heading 2", "Heading 3", "Heading 0", "Heading", "Title"]


def random_documents(n_docs=40, longest=30, seed=3):
    rng = random.Random(seed)
    out = []
    for doc in range(n_docs):
        for pos in range(rng.randrange(longest)):
            text = rng.choice(["plain text.", "  ", "ALL CAPS LINE", "some more words here", " ", "ABC", f"line {pos}"])
            out.append((doc, pos, rng.choice(STYLES), text))
    return out


def expected_blocks(paragraphs):
    """Straight from the definition: what governs a paragraph is found by looking back from it."""
    docs = {}
    for doc, pos, style, text in paragraphs:
        text = " ".join(text.split())
        if not text:
            continue
        level = None
        if style.startswith("Heading"):
            level = int(style.split()[-1]) if style.split()[-1].isdigit() else 1
        else:
            letters = [c for c in text if c.isascii() and c.isalpha()]
            if len(letters) > 3 and all(c.isupper() for c in letters) and len(text.split()) <= 6:
                level = 2
        docs.setdefault(doc, []).append((level, text))
    out = []
    for doc, items in docs.items():
        opened = {}
        for i, (level, text) in enumerate(items):
            if level in (1, 2):
                continue
            before = [j for j in range(i + 1) if items[j][0] is not None]
            tops = [j for j in before if items[j][0] == 1]
            subs = [j for j in before if items[j][0] == 2 and (not tops or j > tops[-1])]
            key = before[-1] if before else -1
            section = items[tops[-1]][1] if tops else None
            subsection = items[subs[-1]][1] if subs else None
            opened.setdefault(key, (section, subsection, []))[2].append(text)
        for n, (section, subsection, texts) in enumerate(opened.values()):
            out.append((doc, n, section, subsection, " ".join(texts)))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("slice_rows", [1, 2, 3, 7, 4096])
def test_blocks_of_paragraphs(spark, slice_rows):
    data = random_documents()
    df = spark.createDataFrame(data, "doc_id long, pos int, style_name string, text string").repartition(5)
    got = blocks.blocks(blocks.elements(df), slice_rows)
    assert [tuple(r) for r in got.orderBy("doc_id", "block_index").collect()] == expected_blocks(data)


def test_blocks_of_whole_documents(spark):
    data = [(d, p, STYLES[p % len(STYLES)], t) for d, p, _, t in random_documents(60, 40, 5)]
    whole = {}
    for doc, _, _, text in data:
        whole.setdefault(doc, []).append(text)
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in whole.items()], "doc_id long, text string")
    names = F.array(*[F.lit(s) for s in STYLES])
    got = blocks.document_blocks(df, style=lambda pos: names[pos % len(STYLES)])
    assert [tuple(r) for r in got.orderBy("doc_id", "block_index").collect()] == expected_blocks(data)


def test_elements(spark):
    cases = [
        ("Heading 1", "A", "heading", 1), ("Heading 3", "A", "heading", 3), ("Heading", "A", "heading", 1), ("Title", "Abc", "paragraph", None),
        ("Normal", "ONE TWO THREE FOUR FIVE SIX", "heading", 2), ("Normal", "ONE TWO THREE FOUR FIVE SIX SEVEN", "paragraph", None),
        ("Normal", "ABC", "paragraph", None), ("Normal", "ABCD", "heading", 2), (None, "ABCD", "heading", 2), ("Heading 2", "  ", None, None),
    ]
    df = spark.createDataFrame([(1, i, s, t) for i, (s, t, _, _) in enumerate(cases)], "doc_id long, pos int, style_name string, text string")
    want = [(i, kind, level) for i, (_, _, kind, level) in enumerate(cases) if kind]
    assert rows(blocks.elements(df), "pos", "type", "level") == want


def test_paragraphs_have_all_lines(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, "")], "doc_id long, text string")
    assert rows(documents.paragraphs(df)) == [(1, 0, "", "a"), (1, 1, "", ""), (1, 2, "", "b"), (1, 3, "", ""), (2, 0, "", "")]


def greedy(counts, limit, overlap):
    """Chunk ends are where the running sum, restarted with the overlap, would pass the limit."""
    first, out = 0, []
    for i in range(1, len(counts) + 1):
        if i == len(counts) or sum(counts[first : i + 1]) > limit:
            out.append((first, i - 1))
            if i < len(counts):
                first = max(first, i - overlap)
                counts_so_far = counts[first : i + 1]
                assert counts_so_far
    return out


def window(counts, limit, overlap):
    first, out = 0, []
    while first < len(counts):
        last = first
        while last + 1 < len(counts) and sum(counts[first : last + 2]) <= limit:
            last += 1
        out.append((max(0, first - overlap), min(len(counts) - 1, last + overlap)))
        first = last + 1
    return out


@pytest.mark.parametrize("mode, model", [("greedy", greedy), ("window", window)])
@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunk_ranges(spark, mode, model, overlap):
    rng = random.Random(overlap)
    lists = [[], [300], [256], [255, 1], [256, 1], [300, 300], [100, 156, 1]] + [
        [rng.choice([1, 5, 40, 120, 255, 256, 300]) for _ in range(rng.randrange(1, 25))] for _ in range(150)
    ]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, c array<int>")
    got = df.select("k", chunks.chunk_ranges(F.col("c"), 256, overlap, mode).alias("r")).collect()
    assert len(got) == len(lists)
    for row in got:
        assert [tuple(r) for r in row["r"]] == model(lists[row["k"]], 256, overlap), lists[row["k"]]


def test_cores_partition_the_sentences(spark):
    counts = [7] * 1000
    df = spark.createDataFrame([(counts,)], "c array<int>")
    ranges = df.select(chunks.chunk_ranges(F.col("c"), 50, 0, "window")).first()[0]
    assert [i for r in ranges for i in range(r["a"], r["b"] + 1)] == list(range(1000))


def test_chunks(spark):
    text = " ".join(f"Sentence number {i}." for i in range(10))
    df = spark.createDataFrame([(1, 0, "S", None, text), (2, 0, None, None, "")], "doc_id long, block_index int, section string, subsection string, text string")
    got = chunks.chunks(df, max_words=9).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == [0, 1, 2, 3]
    assert got[0]["text"] == " ".join(f"Sentence number {i}." for i in range(4))
    assert got[1]["text"] == " ".join(f"Sentence number {i}." for i in range(2, 7))
    assert len({r["chunk_id"] for r in got}) == 4 and all(len(r["chunk_id"]) == 36 for r in got)
    assert [r["chunk_id"] for r in got] == [r["chunk_id"] for r in chunks.chunks(df, max_words=9).orderBy("chunk_index").collect()]
    with pytest.raises(ValueError):
        chunks.chunks(df, mode="other")


def test_long_document(spark):
    """A text of 200,000 words is cut whole, and in reasonable time."""
    text = " ".join(f"Word{i} and two more." for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = chunks.chunks(blocks.document_blocks(df), overlap=0)
    assert got.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == 200_000


def test_text_pipeline_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a.\nb.")], "doc_id long, text string")
    plan = chunks.chunks(blocks.document_blocks(df))._jdf.queryExecution().executedPlan().toString()
    # Arrow batches of numbers pass through Python, rows do not.
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" in plan


def test_cuts_are_linear():
    """Ten times the lines and sentences take about ten times as long, not a hundred times."""
    import time

    import numpy as np

    from txnlens.operators.ranges import cut_blocks, cut_chunks

    def seconds(run):
        best = []
        for _ in range(3):
            begin = time.perf_counter()
            run()
            best.append(time.perf_counter() - begin)
        return min(best)

    for cut in (lambda n: cut_chunks(np.full(n, 7), 20, 1), lambda n: cut_blocks(np.arange(n) % 4)):
        assert seconds(lambda: cut(300_000)) < 25 * seconds(lambda: cut(30_000))


def test_blocks_of_many_lines(spark):
    """A document of 200,000 lines, every fourth a heading."""
    text = "\n".join(f"line {i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = blocks.document_blocks(df, style=lambda pos: F.when(pos % 4 == 0, "Heading 1").otherwise(""))
    assert found.agg(F.count(F.lit(1)), F.sum(F.size(F.split("text", "line")) - 1)).first() == (50_000, 150_000)


def test_stats(spark):
    df = spark.createDataFrame([("a b c",), ("dd",)], "text string")
    assert rows(profile.text_stats(df)) == [(2, 7, 4, 3.5, 2.0, 1, 3)]
    assert rows(profile.text_stats(df.limit(0)))[0][:3] == (0, 0, 0)


def test_chunk_files(spark, tmp_path):
    df = spark.createDataFrame([("id1", 1, "Sé", None, 0, 0, "naïve — 漢字"), ("id2", 1, None, None, 0, 1, 'a "b"')], "chunk_id string, doc_id long, section string, subsection string, block_index int, chunk_index int, text string")
    path = str(tmp_path / "lines")
    documents.write_chunks(df, path)
    assert rows(documents.read_chunks(spark, path)) == rows(df)
    assert "naïve — 漢字" in "".join(p.read_text("utf-8") for p in (tmp_path / "lines").glob("*.json"))
    array = tmp_path / "array.json"
    array.write_text(json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False, indent=2), "utf-8")
    assert rows(documents.read_chunks(spark, str(array), arrays=True)) == rows(df)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED"):
        documents.read_chunks(spark, str(array)).collect()
