"""Sentence boundaries learned from counts."""

import functools
import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from txnlens.operators import sentences as S


def corpus(spark, seed=1):
    """Texts with titles, measures and initials, whose sentences begin with few words."""
    rng = random.Random(seed)
    words = ["bank", "card", "paid", "left", "note", "house", "letter", "money", "street", "window", "carried", "evening"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(3, 9)):
            body = [rng.choice(words) for _ in range(rng.randrange(3, 9))]
            body.insert(rng.randrange(1, len(body)), rng.choice(["Mr. Lee", "e.g. cards", "approx. 3.5 % more", "J. Doe", "Dr. Who", "no stop", "(etc.) and"]))
            parts.append(rng.choice(["He", "She", "It", "They"]) + " " + " ".join(body) + rng.choice([".", ".", ".", "!", "?"]))
        texts.append("  ".join(parts))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_boundaries_are_learned(spark):
    docs = corpus(spark)
    learned = S.learn(docs)
    assert set(learned.abbreviations) == {"mr", "e.g", "approx", "dr", "etc", "j"}
    assert set(learned.starters) == {"he", "she", "it", "they"}
    asked = [
        "Mr. X paid 3.5 % more, e.g. by card. He left! Did she? Yes.",
        "We saw J. Doe and Dr. Who etc. They left.",
        "It was approx. Three days.  It ended etc. The end",
        "Money. Card. 5. Six", None, "", "  ", "no end", "Lee (Mr.) Smith", "He said (etc.) She went",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", S.sentences(F.col("text"), learned).alias("s")).collect()}
    assert got[0] == ["Mr. X paid 3.5 % more, e.g. by card.", "He left!", "Did she?", "Yes."]
    assert got[1] == ["We saw J. Doe and Dr. Who etc.", "They left."]  # a starter ends the sentence
    assert got[2] == ["It was approx. Three days.", "It ended etc. The end"]
    assert got[3] == ["Money.", "Card.", "5.", "Six"]
    assert got[4] == got[5] == got[6] == [] and got[7] == ["no end"]
    assert got[8] == ["Lee (Mr.) Smith"] and got[9] == ["He said (etc.) She went"]  # cut only after a stop itself
    # Without anything learned it is the rule, but for single letters.
    none = S.Boundaries((), ())
    assert df.select(S.sentences(F.col("text"), none).alias("s")).first()["s"][0] == "Mr."


def test_long_lists_are_whole(spark):
    """Words that are not sent to the tasks count all the same, in learning and in cutting."""
    docs = corpus(spark)
    odd = [(None, "Mr. He paid e.g. by card. He left approx. Three. J. Doe (etc.) It ended."), (5, None), (5, ""), (5, "Dr. Who? Mr. Lee."), (5, "Dr. Who? Mr. Lee.")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    all_words = S.learn(docs)
    want = rows(docs.select("doc_id", "text", S.sentences(F.col("text"), all_words).alias("sentences")))
    assert len(all_words.abbreviations) > 2 and len(all_words.starters) > 2 and len(want) == 305
    for most in (0, 2):
        found = S.learn(docs, most=most)
        assert len(found.abbreviations) == len(found.starters) == most
        more = [{r["word"] for r in t.collect()} for t in (found.more_abbreviations, found.more_starters)]
        assert more[0] | set(found.abbreviations) == set(all_words.abbreviations) and len(more[0]) + most == len(all_words.abbreviations)
        assert more[1] | set(found.starters) == set(all_words.starters) and len(more[1]) + most == len(all_words.starters)
        assert rows(S.cut(docs, found)) == want
        with pytest.raises(ValueError):
            S.sentences(F.col("text"), found)
    # One of the lists is short, and the other is joined with a shuffle.
    short = S.Boundaries(all_words.abbreviations, (), None, found.more_starters)
    assert rows(S.cut(docs, short)) == rows(S.cut(docs, S.Boundaries(all_words.abbreviations, tuple(more[1]))))


def test_long_lists_are_joined(spark, monkeypatch):
    """Nor does a list that cannot be broadcast lose words."""
    docs = corpus(spark)
    want = rows(S.cut(docs, S.learn(docs)))
    monkeypatch.setattr(S, "lookup_join", functools.partial(S.lookup_join, broadcast_bytes=0))
    assert rows(S.cut(docs, S.learn(docs, most=1))) == want


def test_counts_are_reduced_where_texts_are_read(spark):
    docs = corpus(spark)
    counts = S.word_counts(docs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    got = {r["word"]: (r["n"], r["n_stop"]) for r in counts.collect()}
    texts = " ".join(r["text"] for r in docs.collect()).split()
    assert got["mr"] == (texts.count("Mr."),) * 2 and got["etc"] == (texts.count("(etc.)"),) * 2
    assert got["he"] == (texts.count("He"), 0) and "3.5" not in got and "%" not in got


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.learn(none) == S.Boundaries((), ())
    assert rows(S.abbreviation_scores(S.word_counts(none))) == []
    assert S.learn(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")) == S.Boundaries((), ())


def test_ends_of_pieces_are_read_once(spark):
    """Long runs and long words are passed over once, where patterns tried at each character would take their square."""
    n = 200_000
    asked = ["x" * n + " end", "a " + "y" * n, "a" + "." * n + "b Dr.", "(a" + "-" * n + "b).", ".-" * n + "a", "!-" * n + "a.", "one two", "(Dr.)", "..e.g.,)", "a..", "Dr.!", "!.", "Σ.", "", "…a　b."]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    start = time.monotonic()
    got = df.select(S._last(F.col("text")).alias("last"), S._type(F.col("text")).alias("type"), S._is_abbreviation(F.col("text"), ("dr", "e.g")).alias("short")).collect()
    assert time.monotonic() - start < 60
    for text, r in zip(asked, got):
        assert r["last"] == re.split(r"[ 　]", text)[-1]
    assert [r["type"] for r in got][6:] == ["one two", "dr", "e.g", "a", "dr", "", "σ", "", "a　b"]
    assert [r["short"] for r in got][6:] == [False, True, True, True, False, False, True, False, False]
    assert [r["short"] for r in got][:6] == [False] * 5 + [True]  # the word of the last is a letter
    assert got[2]["type"] == "a" + "." * n + "b dr" and got[3]["type"] == "a" + "-" * n + "b)"


def test_a_piece_is_looked_at_once(spark):
    docs = corpus(spark)
    plan = docs.select(S.sentences(F.col("text"), S.Boundaries(("dr",), ("he",))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"]+)$, 1)") == 1  # the last token
    plan = S.word_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
