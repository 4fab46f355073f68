"""Encoding and decoding by the token automaton against the library."""

import random

import numpy as np
import pytest
from corpus import SCHEMA, corpus, frame

from txnlens.llm.automaton import Encoder, compile_merges, decode, encode, read_vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_vocabulary(PATH))


def plain(word, merges):
    """Merging as it is defined: the earliest merge that applies, leftmost first."""
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [merges.index(p) for p in zip(parts, parts[1:]) if p in merges]
        if not ranks:
            return parts
        u, v = merges[min(ranks)]
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_any_merges():
    """Random merges, those that no text can use among them."""
    for seed in range(60):
        rng = random.Random(seed)
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(40):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if len(u + v) < 9 and u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        place = {t: i for i, t in enumerate(tokens)}
        made = compile_merges(tokens, [(place[u], place[v]) for u, v in merges])
        walker = Encoder.__new__(Encoder)
        walker.automaton, walker.arcs, walker.root = made, {}, {}
        for token, label in enumerate(tokens):
            if made.born[token] != 1 << 62:
                node = walker.root
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = token
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            path = walker.path(word)
            assert [tokens[t] for t in path] == plain(word, merges)
            # Accepted paths are those that merging gives, and no others.
            state = 0
            for t in path:
                assert made.has_arc(state, t)
                state = made.target[t]


def test_other_token_sequences_are_refused(encoder):
    made, numbers = encoder.automaton, {t: i for i, t in enumerate(encoder.automaton.labels)}
    for parts in ([b"th", b"e"], [b"t", b"h"], [b" ", b"the"], [b"e", b"r"]):
        states, accepted = 0, True
        for p in parts:
            accepted = accepted and made.has_arc(states, numbers[p])
            states = made.target[numbers[p]]
        assert not accepted


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="out of order"):
        compile_merges([b"a", b"b", b"ab", b"aba"], [(2, 0), (0, 1)])


def test_single_texts(encoder, library):
    rng = random.Random(2)
    letters = "etaoins rhdl '.\n\tAB19éüß½²İ\x1c\x85\xa0日本🙂_-<|"
    texts = ["".join(rng.choice(letters if k % 2 else "ethains ") for _ in range(rng.randrange(40))) for k in range(3000)]
    texts += ["".join(f"{chr(c)}x{chr(c)}1{chr(c)}  {chr(c)}" for c in range(0x260)), "a" * 5000, " " * 999 + "x", "ab" * 3000]
    texts += ["<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|", "it's we'll IT'S 'tis"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = corpus(6) + [(200, "x<|endoftext|>y"), (None, "null id"), (201, "日本語 🙂"), (202, "loser " * 3000)]
    found = decode(encode(frame(spark, rows), PATH), PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_any_ids_are_decoded(spark, library):
    rows = [(1, [50256, 262, 1849]), (2, [178]), (3, None), (4, [26344, 229]), (5, [])]
    found = decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert {r[0]: r[2] for r in found} == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in rows}
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([(1, [50257])], "doc_id long, ids array<int>"), PATH).collect()


def test_short_memory(library):
    """What a task remembers does not change results."""
    import txnlens.llm.automaton as module

    kept, module.MEMO = module.MEMO, 3
    try:
        small = Encoder(read_vocabulary(PATH))
        text = "the thonre an erst thatouthing ing the an"
        assert np.frombuffer(small.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        module.MEMO = kept
