"""Grouping of spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, corpus, frame

from txnlens.llm import spelling

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, least_length=6, least=5, times=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("etaoinxé") for _ in range(rng.randrange(6, 10))) for _ in range(30)] + ["ÀBCDEFÿ×", "a" * 300]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(0, 30)):
            w = rng.choice(bases[: 1 + rng.randrange(len(bases))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("etj") + w[at:], w[:at] + rng.choice("etj") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "3", "\n"]).join(words)))
    return rows + [(None, "etaoin " * 50), (1000, None), (1001, ""), (1002, "  12 _"), (5, rows[5][1]), (2000, "qwertyab " * 5 + "qwertya " * 30 + "qwerta " * 200)]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, monkeypatch, small):
    if small:  # so small that the trie is parted, searched in blocks and counted in pieces
        monkeypatch.setattr(spelling, "PART_WORDS", 20)
        monkeypatch.setattr(spelling, "FRONTIER", 50)
        monkeypatch.setattr(spelling, "HELD_WORDS", 30)
    rows = texts(3)
    found = spelling.group_variants(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)
    assert sorted(map(tuple, found.collect())) == want


def test_other_bounds(spark):
    rows = corpus(9) + [(300, "abcde abcdf abcdef xbcdef " * 3)]
    found = spelling.group_variants(frame(spark, rows), least_length=3, least=1, times=2)
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 1, 2)


def test_search_finds_each_pair_once(monkeypatch):
    for seed in range(8):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("abcdejxé") for _ in range(rng.randrange(1, 5 + seed % 4))) for _ in range(300)} | {"a" * 40, "a" * 41, "b" + "a" * 40})
        monkeypatch.setattr(spelling, "FRONTIER", 7 if seed % 2 else 1 << 19)
        a, b = spelling.search(words, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0)
        found = sorted(tuple(sorted((words[x], words[y]))) for x, y in zip(a, b))
        assert found == sorted((v, w) for i, w in enumerate(words) for v in words[:i] if one_edit(v, w))


def test_long_chains(spark):
    words = [("a" * 6 + "b" * k, 5 ** (k + 1)) for k in range(9)]
    near = spelling.near_words(spark.createDataFrame(words, "word string, n long"))
    assert {r["word"]: r["best"] for r in near.collect()} == {w: words[min(k + 1, 8) if k < 8 else 7][0] for k, (w, _) in enumerate(words)}
    text = " ".join(" ".join([w] * n) for w, n in words[:6])
    found = {r["word"]: r["root"] for r in spelling.group_variants(frame(spark, [(1, text)])).collect()}
    want = {r[0]: r[2] for r in plain([(1, text)])}
    assert found == want and len(set(want.values())) < len(want)


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.group_variants(frame(spark, [(1, "short words"), (2, None)])).count() == 0
