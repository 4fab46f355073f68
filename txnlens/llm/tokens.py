"""Token counts of whole texts by a byte-level BPE vocabulary with word ends, mostly without merging.

Whether a pre-token is one token depends on nothing but itself, so it is settled once, ahead of the
job, which strings of the vocabulary encode alone as exactly one token. In a text those pre-tokens
are only looked up and counted; merges run for the rest, once for each distinct one in a while.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
# Counts of merged pre-tokens a task remembers; when full it starts anew.
MEMO = 1 << 18
# Letters of these ranges are composed, have one lower case and no marks; Python's tables and the library's agree on them.
_PLAIN = re.compile("[^\x00-İĲ-ňŊ-ž]")
# Pre-tokens in such a text, as the vocabulary's own pattern cuts them once it is in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Where the two differ on plain characters: signs that Python counts as letters, digits or spaces.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbeİ]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter49k:
    """Counts tokens exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, definition: str, single: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.single = single
        self.letters = _byte_letters()
        specials = [t["content"] for t in json.loads(definition).get("added_tokens", [])]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = self.memo[piece] = len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in piece.encode())))
        return n

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not _PLAIN.search(text) and not _ODD.search(text):
            return _PIECES.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        back = {c: b for b, c in self.letters.items()}
        return [bytes(back[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if "<" in text and self.specials is not None:
            parts = self.specials.split(text)
            total = len(parts) - 1
        for part in parts:
            found = self.pieces(part)
            total += len(found)
            single = self.single
            rest = [p for p in found if p not in single]
            if rest:
                memo = self.memo
                total += sum(memo[p] if p in memo else self.merged(p) for p in rest) - len(rest)
        return total


def single_tokens(definition: str) -> frozenset[str]:
    """Vocabulary strings that the library, given them alone, encodes as one token and one pre-token."""
    tokenizer = Tokenizer.from_str(definition)
    back = {c: b for b, c in _byte_letters().items()}
    special = {t["content"] for t in json.loads(definition).get("added_tokens", [])}
    candidates = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith("</w>") and token not in special:
            try:
                candidates.append(bytes(back[c] for c in token[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a pre-token
    proven = []
    for text, code in zip(candidates, tokenizer.encode_batch(candidates, add_special_tokens=False)):
        if len(code.ids) == 1 and tokenizer.normalizer.normalize_str(text) == text and len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1:
            proven.append(text)
    return frozenset(proven)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row, over the whole text.

    ``vocabulary`` is the path of a word-end BPE definition, read here and sent to the tasks with the
    proven strings: a few MB, given by the vocabulary alone. Null texts are empty; strings of special
    tokens inside a text count as those tokens. Rows keep their ``doc_id``, null or repeated; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        definition = file.read()
    shared = spark.sparkContext.broadcast((definition, single_tokens(definition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter49k(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    slim = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
