"""Operators with a model or an approximate search: held-out accuracy, recall, and exactness of what is reported."""

import math
import random
import zlib

import numpy as np
import pytest
from corpus import SCHEMA, frame

from txnlens.llm import decontaminate, graph_dedup, toxicity
from txnlens.llm.decontaminate import Block, distance_within, drop_contaminated, find_items, normal
from txnlens.llm.graph_dedup import dedup_vectors
from txnlens.llm.toxicity import drop_toxic, score_toxicity

# -- toxicity

ENDS = ["ab", "ic", "on", "er", "ut", "im", "as", "ol"]


def labelled(n=900, seed=3):
    """Prose of invented words; one in five holds a word of a bad stem with any ending."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice("bdfgklm") + rng.choice(ENDS) + rng.choice(ENDS) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["loser", "trash"]) + rng.choice(ENDS))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), 1 - int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    extra = [(5000, None), (5001, ""), (None, "loserzz trashzz"), (5002, "losserqq trashhqq"), (5003, " ".join(["bab"] * 20000) + " loserxx trashyy"), (0, rows[0][1])]
    table = spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0), (6000, 1, 0)], "doc_id long, toxic int, quality int")
    found = score_toxicity(frame(spark, rows + extra), table).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in found}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(by_id[i]["predicted"], y) for i, y, _ in labels if by_id[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    # Misspelled words share n-grams; a toxic word counts in a long text as well; texts without words score alike.
    assert by_id[5002]["predicted"] == by_id[5003]["predicted"] == by_id[None]["predicted"] == 1
    assert by_id[5000]["score"] == by_id[5001]["score"] == 0


def test_held_out_labels_are_not_learned(spark):
    rows, labels = labelled(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, q) for i, y, q in labels]
    schema = "doc_id long, toxic int, quality int"
    a, b = (sorted(map(tuple, score_toxicity(frame(spark, rows), spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(frame(spark, [(1, "a"), (2, None)]), none).count() == 2
    assert score_toxicity(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_toxic_rows_go(spark):
    rows, labels = labelled(500)
    docs = frame(spark, rows)
    kept = drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    bad = {i for i, y, _ in labels if y}
    assert len(ids & bad) <= 0.05 * len(bad) and len(set(range(500)) - bad - ids) <= 5


def test_subwords_do_not_depend_on_company():
    many = ["loser", "a", "straße", "x" * 300]
    word, bucket = toxicity.subwords(many)
    for k, one in enumerate(many):
        assert sorted(bucket[word == k]) == sorted(toxicity.subwords([one])[1])


# -- decontamination


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_distance():
    rng = random.Random(5)
    for _ in range(300):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        assert distance_within(item, text, 99) == plain_distance(item, text)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "in", "re", "on", "at", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(text)), rng.randrange(3)
        if kind == 0:
            text[k] = rng.choice("abcdefgh")
        elif kind == 1:
            del text[k]
        else:
            text.insert(k, rng.choice("abcdefgh"))
    return "".join(text)


def test_items_are_found(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(20, 60))) for k in range(40)]
    rows, planted = [], []
    for k, (i, text) in enumerate(items):
        edits = int(len(text) * (0, 0, 0.02, 0.05)[k % 4])
        inner = edited(rng, text, edits).upper() if k % 2 else edited(rng, text, edits).replace(" ", " \n", 3)
        rows.append((k, prose(rng, 30) + " " + inner + "\t" + prose(rng, 30)))
        planted.append((k, i))
    rows += [(1000 + k, prose(rng, 200)) for k in range(60)]  # clean
    rows += [(2000, None), (2001, ""), (None, items[0][1]), (2002, items[1][1]), (2002, items[1][1]), (2003, prose(rng, 30000) + " " + items[2][1])]
    bench = spark.createDataFrame([*items, (500, None), (501, ""), (502, "short"), (503, items[4][1]), (4, items[4][1])], "item_id long, text string")
    docs = frame(spark, rows)
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_items(docs, bench).collect()}
    exact = [p for k, p in enumerate(planted) if k % 4 < 2]
    assert all(found.get(p) == 0 for p in exact)
    assert sum(p in found for p in planted) >= 0.95 * len(planted)
    assert found[2002, 1] == found[None, 0] == found[2003, 2] == found[4, 503] == 0
    texts, by_item = {i: normal(t) for i, t in rows}, dict(items) | {503: items[4][1]}
    for (i, item), d in found.items():  # nothing is reported that is not within the distance
        want = normal(by_item[item])
        assert d <= int(0.08 * len(want))
        assert i == 2003 or i is None or plain_distance(want, texts[i]) <= d
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(1000, 1060)) <= set(ids) and None in ids and not {2002, 2003} & set(ids)


def test_walks_reach_the_recall():
    rng = random.Random(9)
    items = [normal(prose(rng, 40)) for _ in range(60)]
    block = Block(list(range(60)), items, 0.08, 0.98)
    for share, least in ((0.0, 1.0), (0.03, 0.98), (0.05, 0.95)):
        texts = [normal(prose(rng, 20) + " " + edited(rng, i.decode(), int(share * len(i))) + " " + prose(rng, 20)) for i in items]
        got = {(r, i) for r, i, _ in block.matches(texts)}
        assert sum((k, k) in got for k in range(60)) >= least * 60


def test_items_are_found_where_no_word_begins():
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x6000)) for _ in range(n))
    items = [normal(han(40)) for _ in range(20)] + [normal(prose(rng, 30)) for _ in range(20)]
    texts = [normal(han(100)) + i + normal(han(100)) for i in items[:20]]
    texts += [b"https://example.com/?q='(\"" + i + b'")' for i in items[20:]]
    found = {(r, i): d for r, i, d in Block(list(range(40)), items, 0.08, 0.98).matches(texts)}
    assert found == {(k, k): 0 for k in range(40)}
    texts = [b"x" * 50 + edited(rng, i.decode("latin-1"), int(0.08 * len(i))).encode("latin-1") + b"x" * 50 for i in items]
    found = {(r, i) for r, i, _ in Block(list(range(40)), items, 0.08, 0.98).matches(texts)}
    assert found == {(k, k) for k in range(40)}  # edited up to the bound, too


def test_copies_at_the_bound_are_found(spark):
    """Edits as even as can be, also in short items and with more than a ninth of the bytes edited."""
    rng = random.Random(13)
    items = [(k, normal(prose(rng, 60))[: (81, 13, 26, 200)[k % 4]].decode().strip() + "q") for k in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for share in (0.08, 0.09, 0.15):
        rows = []
        for k, text in items:
            edits = int(share * len(text))
            cut = [(i + 1) * len(text) // (edits + 1) for i in range(edits)]
            rows.append((k, "yy" + "".join("#" if i in cut else c for i, c in enumerate(text)) + "zz"))
        found = {(r["doc_id"], r["item_id"]) for r in find_items(frame(spark, rows), bench, share).collect()}
        assert found >= {(k, k) for k, _ in items}


def test_long_benchmarks_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, prose(rng, 30)) for k in range(30)]
    docs = frame(spark, [(k, "x " + t + " y") for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    monkeypatch.setattr(decontaminate, "BROADCAST", 1500)
    assert {(r["doc_id"], r["item_id"]) for r in find_items(docs, bench).collect()} >= {(k, k) for k in range(30)}


def test_short_items_are_whole_words(spark):
    items = [(1, "Yes"), (2, "a b"), (3, "it's so"), (4, ""), (5, None), (6, "eightby8"), (7, "yes")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "oh YES\tsir"), (2, "yesterday"), (3, "x a  b"), (4, "ba b"), (5, "it's\nso"), (6, "eightby8"), (7, None), (8, ""), (9, "xeightby8")]
    found = {tuple(r) for r in find_items(frame(spark, rows), bench).collect()}
    assert found == {(1, 1, 0), (1, 7, 0), (3, 2, 0), (5, 3, 0), (6, 6, 0)}
    docs = frame(spark, rows)
    assert drop_contaminated(docs, bench).count() == len(rows)
    assert {r[0] for r in drop_contaminated(docs, bench, least_bytes=3).collect()} == {2, 4, 7, 8, 9}


def test_all_pairs_of_documents_and_items(spark):
    """Against the plain distance of every document to every item: all within the share, and no others."""
    rng = random.Random(14)
    items = [(k, prose(rng, rng.randint(2, 14))) for k in range(14)] + [(20, "tiny"), (21, "two words")]
    rows = []
    for k, (i, text) in enumerate(items * 3):
        inner = edited(rng, text, int(len(text) * rng.choice([0, 0.04, 0.08, 0.12])))
        rows.append((k, rng.choice(["", "xx", "x "]) + inner + rng.choice(["", "yy", " y"]) + " " + prose(rng, 8)))
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in rows:
        for i, item in items:
            a, b = normal(item), normal(text)
            if len(a) < decontaminate.RUN:
                if b" " + a + b" " in b" " + b + b" ":
                    want[d, i] = 0
            elif (distance := plain_distance(a, b)) <= int(0.08 * len(a)):
                want[d, i] = distance
    assert found == want and len(want) > 25


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_items(frame(spark, [(1, "a b c")]), bench).count() == 0
    assert find_items(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "some long item text here")], "item_id long, text string")).count() == 0


# -- vectors


def plain_links(rows, least):
    vectors = []
    for i, v, label in rows:
        x = None
        if i is not None and v and label is not None and all(z is not None and np.isfinite(z) for z in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            x = x / np.sqrt((x * x).sum())
        vectors.append(x)
    links = [0] * len(rows)
    low = {r[0]: r[0] for r in rows if r[0] is not None}
    pairs = []
    for a in range(len(rows)):
        for b in range(len(rows)):
            x, y = vectors[a], vectors[b]
            if a != b and x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                pairs.append((rows[a][0], rows[b][0]))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return [(i, n, low.get(i), i is not None and low[i] == i) for (i, _, _), n in zip(rows, links)]


def points(seed=4, n=250):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 5
        base = rng.normal(size=16)
        if kind == 1 and i:
            base = np.array(rows[-1][1]) + rng.normal(size=16) * 0.05
        if kind == 2:
            base = np.ones(16) + rng.normal(size=16) * 0.08  # one dense cluster
        if kind == 3 and i > 10:
            base = np.array(rows[3][1])  # exact copies
        rows.append((i * 2, [float(np.float32(x)) for x in base], 1 if kind in (2, 3) else i % 3))
    rows += [
        (1, None, 1), (3, [], 1), (5, [0.0] * 16, 1), (7, [float("nan")] + [1.0] * 15, 1), (9, [float("inf")] + [1.0] * 15, 1), (11, [None] + [1.0] * 15, 1),
        (13, [1.0] * 16, None), (None, [1.0] * 16, 1), (15, [1.0] * 3, 1), (17, [1.0] * 3, 1), (19, [1e200] * 16, 1), (21, [1e-200] * 16, 1), (rows[3][0], rows[3][1], rows[3][2]), (0, [-1.0] * 16, 1),
    ]
    return rows


SMALL = "vec_id long, embedding array<double>, label int, rep long, homes string"


@pytest.mark.parametrize("shard,largest", [(1024, 4096), (40, 4096), (40, 30)])
def test_vectors(spark, monkeypatch, shard, largest):
    monkeypatch.setattr(graph_dedup, "SHARD", shard)
    monkeypatch.setattr(graph_dedup, "LARGEST", largest)
    rows = points()
    found = sorted(map(tuple, dedup_vectors(spark.createDataFrame([(*r, 1, "h") for r in rows], SMALL)).collect()), key=str)
    want = sorted(plain_links(rows, 0.93), key=str)
    total, hit = sum(r[1] for r in want), sum(min(a[1], b[1]) for a, b in zip(found, want))
    assert all(a[1] <= b[1] for a, b in zip(found, want)) and hit >= 0.97 * total
    if shard == 1024:  # one shard a label
        assert found == want


def test_no_vectors(spark):
    assert dedup_vectors(spark.createDataFrame([], SMALL)).count() == 0
    one = dedup_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1, 1, "h")], SMALL)).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, True)]


def test_graph_is_searched_to_its_ends():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    x[200:] = x[:200] + rng.normal(size=(200, 32)) * 0.1
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = graph_dedup.pruned_graph(x)
    a, b = graph_dedup.search_in_range(x, near, 0.93)
    true = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    found = set(zip(a.tolist(), b.tolist()))
    assert sum((i, j) in found for i, j in true) >= 0.97 * len(true)
    angle = np.linspace(0, 3, 300)  # on an arc a near neighbour makes the farther ones needless
    assert (graph_dedup.pruned_graph(np.stack([np.cos(angle), np.sin(angle)], axis=1)) >= 0).sum(axis=1).mean() < graph_dedup.DEGREE / 2


def grouped(rng, groups, size, noise, dim=64):
    """Unit vectors in groups around random centres; the cosine in a group is about 1 / (1 + noise²)."""
    centre = np.repeat(rng.normal(size=(groups, dim)) / math.sqrt(dim), size, axis=0)
    return centre + rng.normal(size=centre.shape) * noise / math.sqrt(dim)


def numbered(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in v], 1, i, "h") for i, v in enumerate(x)], SMALL)


def true_links(x, least):
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x @ x.T >= least).sum(axis=1) - 1


def test_groups_larger_than_the_pool(spark):
    """All neighbours in a graph's lists are of the own group: no group is reached from another."""
    x = grouped(np.random.default_rng(6), 12, 100, 0.15)
    want = true_links(x, 0.93)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dedup_vectors(numbered(spark, x)).collect()}
    assert min(want) >= 90 and [found[i][0] for i in range(len(x))] == want.tolist()
    assert [found[i][1] for i in range(len(x))] == [i // 100 * 100 for i in range(len(x))]


def test_unmeasured_recall_is_not_enough(spark, monkeypatch):
    """Where no drawn vector has links, shards go on to overlap; where all were drawn there are none."""
    asked, compare = [], graph_dedup._compare
    monkeypatch.setattr(graph_dedup, "_compare", lambda reps, overlap, least: asked.append(overlap) or compare(reps, overlap, least))
    rows = [(i, [1.0 * (j == i) for j in range(40)], 1) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    assert dedup_vectors(vectors).filter("n_links > 0").count() == 0 and asked == [graph_dedup.OVERLAPS[0]]
    asked.clear()
    monkeypatch.setattr(graph_dedup, "DRAWN", 4)
    monkeypatch.setattr(graph_dedup, "AUDITED", 4)
    assert dedup_vectors(vectors).filter("n_links > 0").count() == 0 and asked == [*graph_dedup.OVERLAPS, None]


def test_audit_counts_lost_pairs(spark):
    """A fiftieth of the vectors is linked in pairs, half of them are lost, and a large group is whole."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(5000, 32)), grouped(rng, 1, 300, 0.2, 32)])
    x[1:200:2] = x[0:200:2] + rng.normal(size=(100, 32)) * 0.05
    reps = numbered(spark, x).selectExpr("vec_id as rep", "1L as part", "embedding as vector", "1L as n")
    want = true_links(x, 0.93)
    truth, complete = graph_dedup._truth(reps, 0.93)
    assert complete
    assert all(want[r["rep"]] == r["truth"] for r in truth.collect())
    whole = [(i, i, int(n)) for i, n in enumerate(want) if n]
    schema = "a long, b long, n_links long"
    assert graph_dedup._audit(truth, spark.createDataFrame(whole, schema)) == 1.0
    assert graph_dedup._audit(truth, spark.createDataFrame([r for r in whole if not r[0] < 100], schema)) < 0.7
    assert graph_dedup._audit(truth.limit(0), spark.createDataFrame(whole, schema)) is None


def test_exact_where_overlap_is_not_enough(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 5)
    monkeypatch.setattr(graph_dedup, "OVERLAPS", (1,))
    monkeypatch.setattr(graph_dedup, "LARGEST", 200)
    x = grouped(np.random.default_rng(8), 300, 2, 0.25)
    found = {r["vec_id"]: r["n_links"] for r in dedup_vectors(numbered(spark, x)).collect()}
    assert [found[i] for i in range(len(x))] == true_links(x, 0.93).tolist()
