"""Phrase mining against a plain version."""

import random
import re
from collections import Counter

import pytest
from corpus import SCHEMA, corpus, frame

from txnlens.llm import phrases

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, top):
    """``rows`` of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in found.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words) and a >= f[lang, words[i:j]]:
                    gone.add((lang, words[i:j]))
    out = []
    for (lang, words), a in found.items():
        if (lang, words) not in gone:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    want = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        want += [(lang, k, *r[1:]) for k, r in enumerate(mine[:top], 1)]
    return sorted(want)


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        words = [rng.choice("the of a in at New york City it's café x-1 ÀB".split()) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ", "!?"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    rows += [("en", "hot pair " + rng.choice("abcdefgh") + " " + rng.choice("abcdefgh") + " end") for _ in range(150)]
    rows += [("en", "the same passage that is everywhere")] * 40
    return rows + [("fr", None), ("fr", ""), ("fr", " \t.\n"), (None, "..."), ("es", "one two " * 2000), ("es", "\x01a \x02b " * 30)]


def as_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("least,top,hot", [(5, 2000, None), (3, 20, 40), (20, 7, 100)])
def test_collocations(spark, monkeypatch, least, top, hot):
    if hot:  # so small that prefixes are followed, shards are many and places are united apart
        monkeypatch.setattr(phrases, "PLACE_RUNS", hot)
        monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
        monkeypatch.setattr(phrases, "SORTED_WORDS", 300)
        monkeypatch.setattr(phrases, "ROW_WORDS", 50)
        monkeypatch.setattr(phrases, "UNITED_STATES", 100)
        monkeypatch.setattr(phrases, "FILTER_BITS", (1 << 12, 1 << 12))
        monkeypatch.setattr(phrases, "BROADCAST_WORDS", 0 if hot == 40 else 1 << 20)
    rows = texts(least)
    found = phrases.collocations(as_frame(spark, rows), least, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, least, top)


def test_clashing_columns_and_repeated_rows(spark):
    rows = corpus(8)
    df = frame(spark, rows).selectExpr("*", "'q' as lang", "1 as ids", "2 as place", "3 as word", "4 as shard")
    assert sorted(map(tuple, phrases.collocations(df, 2, 50).collect())) == plain([("q", t) for _, t in rows], 2, 50)


def test_no_phrases(spark):
    none = spark.createDataFrame([], SCHEMA).selectExpr("*", "source as lang")
    assert phrases.collocations(none).count() == 0
    few = as_frame(spark, [("en", "one two three"), (None, None)])
    assert phrases.collocations(few).count() == 0
