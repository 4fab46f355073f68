"""Operators with exact results against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus import SCHEMA, corpus, frame, words

from txnlens.llm import induced, kernels, ngram_join, repeats, suffix
from txnlens.llm.components import components
from txnlens.llm.ngram_join import join_similar, keep_one_of_similar
from txnlens.llm.substring import remove_repeated_runs
from txnlens.llm.suffix import remove_repeated_bytes
from txnlens.llm.tokens import Counter49k, count_tokens, single_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def covered(rows, items, size):
    """Plain version: for every row which items are covered by a run that an earlier document starts."""
    first = {}
    for i, text in rows:
        if i is not None:
            got = items(text)
            for s in range(len(got) - size + 1):
                run = tuple(got[s : s + size])
                first[run] = min(i, first.get(run, i))
    out = []
    for i, text in rows:
        got = items(text)
        gone = [False] * len(got)
        for s in range(len(got) - size + 1):
            if i is not None and first[tuple(got[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out.append((i, got, gone))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("window", [2, 13, 30])
def test_word_runs(spark, window):
    rows = corpus() + [(None, " ".join(["w1"] * 30))]
    found = remove_repeated_runs(frame(spark, rows), window).collect()
    want = []
    for i, got, gone in covered(rows, split, window):
        kept = b" ".join(w for w, g in zip(got, gone) if not g)
        want.append((i, len(got), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    assert ordered(map(tuple, found)) == ordered(want)


@pytest.mark.parametrize("length", [8, 50])
def test_byte_runs(spark, length):
    rows = corpus(2) + [(None, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = [(i, t if t is None else t[:4000]) for i, t in rows]  # the plain version is quadratic in the length
    found = remove_repeated_bytes(frame(spark, rows), length).collect()
    want = []
    for i, got, gone in covered(rows, lambda t: (t or "").encode(), length):
        kept = bytes(b for b, g in zip(got, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(got), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest()))
    assert ordered((*r[:4], bytes(r[4]), r[5]) for r in found) == ordered(want)


def test_byte_runs_do_not_depend_on_the_order_of_rows(monkeypatch):
    """The rows of a chunk are fetched anew for each step, from several executors in any order."""
    import pyarrow as pa
    import pyarrow.compute

    monkeypatch.setattr(suffix, "BATCH", 1 << 11)
    rng, length, n = random.Random(8), 50, 3
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(50, 80))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(texts) + "".join(rng.choices("xyz", k=20)) for _ in range(3))) for i in range(120)]

    def chunk(k, order):
        mine = [rows[i] for i in order if i % 2 == k]
        h = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:7]) for _, t in mine]
        return pa.table({"chunk": pa.array([k] * len(mine), pa.int32()), "doc_id": [i for i, _ in mine], "text": [t for _, t in mine], "h1": h, "h2": h})

    def each(run, replies, order):
        out = []
        for k in (0, 1):
            table = replies.filter(pa.compute.equal(replies["chunk"], k))
            out.append(run(repeats.Chunk(chunk(k, order)), repeats.read_replies(table) | {"table": table}))
        return pa.concat_tables(out)

    def answers(run, parts):
        return pa.concat_tables([run(parts.filter(pa.compute.equal(parts["bucket"], b))) for b in parts["bucket"].unique().to_pylist()])

    orders = [rng.sample(range(len(rows)), len(rows)) for _ in range(3)]
    none = repeats._pack([], repeats._REPLIES)
    seen = answers(repeats._seen_reply(suffix.SEEN), each(suffix._seek(length, n), none, orders[0]))
    pieces = each(suffix._send(length, n), seen, orders[1])
    assert pieces.equals(each(suffix._send(length, n), seen, orders[2]))
    # What is sent from one chunk is there once, also if it stands in several batches.
    for keys, body in zip(pieces["keys"].to_pylist(), pieces["extra"].to_pylist()):
        sizes = np.frombuffer(keys, np.uint64).reshape(2, -1)[0].astype(int)
        cut = [body[e - s : e] for s, e in zip(sizes, np.cumsum(sizes))]
        assert len(cut) == len(set(cut))
    strings = answers(suffix._sort(length), pieces)
    found = each(suffix._remove(length, n), pa.concat_tables([seen, strings]), orders[2])
    want = [(i, hashlib.sha256(bytes(b for b, g in zip(got, gone) if not g)).hexdigest()) for i, got, gone in covered(rows, str.encode, length)]
    assert ordered(zip(found["doc_id"].to_pylist(), found["kept_sha256"].to_pylist())) == ordered(want)


def sets(rows, size):
    upper = bytes(range(65, 91))
    out = {}
    for i, text in rows:
        got = split((text or "").encode().translate(bytes.maketrans(upper, upper.lower())).decode())
        shingles = {tuple(got[k : k + size]) for k in range(len(got) - size + 1)} or ({tuple(got)} if got else set())
        out.setdefault(i, []).append(shingles)
    return out


def joined(rows, size, percent):
    """Plain version: component of every document."""
    nodes = [(i, s) for i, several in sets(rows, size).items() if i is not None for s in several]
    low = {i: i for i, _ in nodes}
    changed = True
    while changed:
        changed = False
        for i, a in nodes:
            for j, b in nodes:
                if a and b and 100 * len(a & b) >= percent * len(a | b) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return low


@pytest.mark.parametrize("size,percent,tile", [(3, 90, None), (5, 80, None), (3, 90, 600), (2, 60, 300)])
def test_similar(spark, monkeypatch, size, percent, tile):
    if tile:  # so small that blocks are cut into tiles
        monkeypatch.setattr(ngram_join, "TILE_ENTRIES", tile)
        monkeypatch.setattr(ngram_join, "LEAST_ENTRIES", 1)
    rows = corpus(3) + [(None, "one"), (None, None)]
    found = join_similar(frame(spark, rows), size, percent).collect()
    low = joined(rows, size, percent)
    want = [(i, len(s), low.get(i)) for i, several in sets(rows, size).items() for s in several]
    assert ordered(map(tuple, found)) == ordered(want)


def test_one_of_each_group_stays(spark):
    rows = corpus(4) + [(None, "one")]
    low = joined(rows, 5, 80)
    found = keep_one_of_similar(frame(spark, rows))
    assert found.columns == frame(spark, []).columns
    assert ordered(r[:2] for r in found.collect()) == ordered((i, t) for i, t in rows if i is None or low[i] == i)


def test_texts_of_one_id_join_their_copies(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 30, 1000)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (9, b), (12, ""), (13, ""), (13, a), (20, c), (21, c), (21, " "), (30, "")]
    found = join_similar(frame(spark, rows), 3, 90).collect()
    low = joined(rows, 3, 90)
    assert low[9] == 3
    assert ordered((r["doc_id"], r["component_id"]) for r in found) == ordered((i, low[i]) for i, _ in rows)


def test_rarest_are_shared_by_linked_sets():
    rng = np.random.default_rng(3)
    for percent in (50, 60, 80, 90, 100):
        for _ in range(200):
            common = rng.integers(0, 40, 30)
            a, b = (np.unique(np.append(rng.permutation(common)[: rng.integers(15, 31)], rng.integers(40 + 50 * k, 90 + 50 * k, rng.integers(0, 6)))) for k in (0, 1))
            row = np.repeat([0, 1], [len(a), len(b)])
            values = np.concatenate([a, b])
            shared = np.isin(values, np.intersect1d(a, b))
            # Some are shared with other documents only.
            shared |= values % 7 == 0
            hit = ngram_join.rarest(row, shared, np.array([len(a), len(b)]), percent)
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert len(np.intersect1d(values[hit & (row == 0)], values[hit & (row == 1)]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_runs(none).count() == 0
    assert remove_repeated_bytes(none).count() == 0
    assert join_similar(none).count() == 0
    assert count_tokens(none, VOCABULARY).count() == 0


def test_tokens(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rows = corpus(5) + [
        (200, "It's <|endoftext|> and<|startoftext|>, don't"), (201, "<|ENDOFTEXT|> __a__ 12½ ǅ ſ İ e\u0301 \u0301"),
        (202, "日本語 🙂🙂 naïve"), (None, "null id"), (203, "loser " * 3000),
    ]
    found = count_tokens(frame(spark, rows), VOCABULARY).collect()
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert ordered(map(tuple, found)) == ordered(want)


def test_single_tokens_are_proven():
    from tokenizers import Tokenizer

    definition = open(VOCABULARY, encoding="utf-8").read()
    library, proven = Tokenizer.from_str(definition), single_tokens(definition)
    assert {"the", "and", "!"} <= proven and len(proven) > 30000
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in list(proven)[::97])
    counter = Counter49k(definition, frozenset())  # without the shortcut everything is merged
    assert counter.count("the unbelievable thonre") == len(library.encode("the unbelievable thonre", add_special_tokens=False).ids)


def test_induced_sorting():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(0, 20, rng.integers(1, 12))
        data = rng.integers(97, 97 + rng.integers(1, 4), sizes.sum()).astype(np.uint8)
        cap = int(rng.integers(1, 12))
        # A limit of a few bytes sends every queue to disk.
        _, places, common = induced.sort_suffixes(data, sizes, cap, limit=int(rng.integers(1, 200)))
        text, at = [], 0
        for s in sizes:
            text += [int(x) + 2 for x in data[at : at + s]] + [1]
            at += s
        text.append(0)
        assert sorted(places.tolist()) == list(range(len(text) - 1))
        heads = [tuple(text[p : p + cap]) for p in places]
        assert heads == sorted(heads)
        for k in range(1, len(heads)):
            same = 0
            while same < min(len(heads[k]), len(heads[k - 1])) and heads[k][same] == heads[k - 1][same]:
                same += 1
            assert common[k] == same


def test_anchors_follow_the_content():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        items = rng.integers(0, rng.integers(2, 50), 200).astype(np.uint64)
        offsets, window, part = np.array([0, 40, 40, 100, 200]), 13, int(rng.integers(2, 12))
        ok, place, key = kernels.anchors(items, offsets, window, part)
        hashes = kernels.window_hashes(items, part)
        for s in range(len(place)):
            inside = hashes[s : s + window - part + 1]
            assert place[s] == s + int(np.argmin(inside)) and key[s] == kernels.mix(inside.min().reshape(1))[0]
            assert ok[s] == any(a <= s and s + window <= b for a, b in zip(offsets, offsets[1:]))


def test_words_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    rows = [None, "", " a\tbb\x0b cc\u00e9 \n", "X" * 50, "y z"]
    results = []
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(kernels, "BLOCK_BYTES", size)
        t = kernels.texts(pa.array(rows))
        w = kernels.words(t, fold_case=True)
        assert [t.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [x for r in rows for x in split(r)]
        results.append(w.hash.tolist())
    assert results[0] == results[1] == results[2]


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 200)] + [(300, 301), (301, 300), (5, 5), (400, 300), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[k] == 1 for k in range(1, 201)) and found[400] == found[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
