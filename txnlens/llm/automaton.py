"""Byte-level BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that merging gives, and each string of bytes is
spelled by one accepted path. It is made from the merges in their order: it begins as one state with
a loop for every byte, and the merge of ``u`` and ``v`` into ``t`` puts a gadget behind ``u``:

- arcs of ``u`` now lead to a copy of the state they led to that lacks the arc of ``v``;
- each state with an arc of ``u`` gets an arc of ``t`` to where ``v`` led behind ``u``.

All arcs of one token lead to one state, so a state is kept as the copy it is: the state it was
copied from, the arc it lacks, and when. Arcs are written out in a table as they are first taken.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# Encoded pre-tokens, and written arcs, that a task remembers; when full it starts anew.
MEMO = 1 << 19
# Code points whose class all Unicode versions agree on: below U+0250, without signs that some take for blanks.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼½¾"
_BLANK = "\t-\r "
# Pre-tokens of such texts, as byte-level vocabularies cut them.
_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Automaton:
    """Tokens and states as numbers; state 0 is the first one, made at time 0 like the bytes."""

    labels: list[bytes]  # what the arc of a token spells
    first: list[int]  # the token's first half, -1 for bytes
    born: list[int]  # the merge that made it, from 1; 0 for bytes, _NEVER if no text has it
    target: list[int]  # where all its arcs lead
    parent: list[int]  # the state that a state is a copy of
    lacks: list[int]  # the arc it was made without
    made: list[int]  # the merge that made it

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state``."""
        first, born, made = self.first, self.born, self.made
        while born[token] != _NEVER:
            when = born[token]
            if when and when >= made[state]:
                token = first[token]  # the arc came later, to states with one of its first half
            elif not state:
                return True
            elif self.lacks[state] == token:
                return False
            else:
                state = self.parent[state]
        return False


def compile_merges(labels: list[bytes], merges: list[tuple[int, int]]) -> Automaton:
    """The automaton of merges in their order, each a pair of tokens whose bytes joined are a token.

    Raises ``ValueError`` if two merges make one token, or one uses a token before it is made.
    """
    numbers = {label: i for i, label in enumerate(labels)}
    n = len(labels)
    born = [0 if len(label) == 1 else _NEVER for label in labels]
    a = Automaton(labels, [-1] * n, born, [0] * n, [0], [-1], [0])
    done = set()
    for time, (u, v) in enumerate(merges, 1):
        token = numbers[labels[u] + labels[v]]
        if token in done or len(labels[token]) < 2 or any(len(labels[x]) > 1 and x not in done for x in (u, v)):
            raise ValueError(f"merge {time} is out of order or makes a token again")
        done.add(token)
        behind = a.target[u]
        if a.born[u] == _NEVER or not a.has_arc(behind, v):
            continue  # earlier merges always part the two
        a.first[token], a.born[token], a.target[token] = u, time, a.target[v]
        a.target[u] = len(a.parent)
        a.parent.append(behind)
        a.lacks.append(v)
        a.made.append(time)
    return a


@dataclass
class Vocabulary:
    """What tasks need of a byte-level BPE definition."""

    definition: str
    automaton: Automaton
    numbers: list[int]  # id of each of the automaton's tokens
    special: dict[str, int]
    encoder: Encoder | None = None  # one for all tasks of a process

    def shared_encoder(self) -> Encoder:
        if self.encoder is None:
            self.encoder = Encoder(self)
        return self.encoder


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE definition; raises ``ValueError`` on settings that other merges would need."""
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    parts = json.loads(definition)
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    if parts["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        raise ValueError("not a byte-level definition without added blanks")
    if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("merges alone must decide")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
        raise ValueError("special tokens must not take blanks")
    special = {t["content"]: t["id"] for t in parts["added_tokens"]}
    back = byte_letters()
    texts = [t for t in model["vocab"] if t not in special]
    place = {t: i for i, t in enumerate(texts)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    automaton = compile_merges([bytes(back[c] for c in t) for t in texts], [(place[u], place[v]) for u, v in pairs])
    return Vocabulary(definition, automaton, [model["vocab"][t] for t in texts], special)


class Encoder(dict):
    """Pre-tokens to their packed 32-bit ids, found by the automaton's arcs when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = vocabulary.automaton
        self.ids = vocabulary.numbers
        self.arcs: dict[int, int] = {}
        self.root: dict = {}
        for token, label in enumerate(vocabulary.automaton.labels):
            if vocabulary.automaton.born[token] != _NEVER:
                node = self.root
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = token
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.packed = {text: np.int32(i).tobytes() for text, i in vocabulary.special.items()}
        self.cutter = Tokenizer.from_str(vocabulary.definition).pre_tokenizer
        self.letters = byte_letters()

    def _step(self, state: int, token: int) -> int:
        """The state behind ``token``, or -1."""
        key = state << 32 | token
        to = self.arcs.get(key)
        if to is None:
            if len(self.arcs) >= MEMO:
                self.arcs.clear()
            to = self.arcs[key] = self.automaton.target[token] if self.automaton.has_arc(state, token) else -1
        return to

    def _ahead(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Tokens that spell bytes from ``at`` on, with their ends, short ones first."""
        node, out = self.root, []
        for end in range(at, len(word)):
            node = node.get(word[end])
            if node is None:
                break
            if -1 in node:
                out.append((node[-1], end + 1))
        return out

    def path(self, word: bytes) -> list[int]:
        """Tokens of the one accepted path that spells ``word``.

        Long arcs are tried first. A place is reached by one path only, so one that leads nowhere is
        given up for good and the work stays in proportion to the length.
        """
        open_places, tokens, dead, at, state = [], [], set(), 0, 0
        while at < len(word):
            open_places.append((at, state, self._ahead(word, at)))
            while True:
                at, state, options = open_places[-1]
                found = -1
                while options and found < 0:
                    token, end = options.pop()
                    if end not in dead:
                        found = self._step(state, token)
                if found >= 0:
                    tokens.append(token)
                    at, state = end, found
                    break
                open_places.pop()
                dead.add(at)
                tokens.pop()
        return tokens

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self.ids
        packed = self[piece] = np.array([ids[t] for t in self.path(piece.encode())], np.int32).tobytes()
        return packed

    def _pieces(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return _PIECES.findall(text)
        back = self.letters
        return [bytes(back[c] for c in p).decode() for p, _ in self.cutter.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; strings of special tokens are those tokens."""
        if self.special is None or "<" not in text and not self.special.search(text):
            return b"".join(map(self.__getitem__, self._pieces(text)))
        parts = self.special.split(text)
        return b"".join(self.packed[p] if i % 2 else b"".join(map(self.__getitem__, self._pieces(p))) for i, p in enumerate(parts))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, ids)`` for each row: the tokens of its whole text, as merging gives them.

    ``vocabulary`` is the path of a byte-level BPE definition, read here and sent to the tasks
    compiled: some MB, given by the vocabulary alone. Null and empty texts have no tokens. Rows keep
    their ``doc_id``, null or repeated; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.shared_encoder()
        for batch in batches:
            packed = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["doc_id", "ids"])

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded`` to rows with ``ids``: the arcs' labels in order, special tokens included.

    Bytes that are no UTF-8 become U+FFFD, and null ``ids`` the empty text. An id that the
    vocabulary lacks raises ``ValueError``.
    """
    read = read_vocabulary(vocabulary)
    size = max([*read.numbers, *read.special.values()]) + 1
    labels = [b""] * size
    known = np.zeros(size, bool)
    for number, label in [*zip(read.numbers, read.automaton.labels), *((i, t.encode()) for t, i in read.special.items())]:
        labels[number], known[number] = label, True
    shared = encoded.sparkSession.sparkContext.broadcast((labels, known))
    schema = "doc_id long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, known = shared.value
        spelled = np.array(labels, dtype=object)
        for batch in batches:
            column = batch.column(1)
            texts = []
            for row in range(len(column)):
                ids = column[row].values
                ids = np.zeros(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(known) or not known[ids].all()):
                    raise ValueError("id is not in the vocabulary")
                texts.append(b"".join(spelled[ids].tolist()).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, schema)
