"""Variants of spelling: words one edit apart, grouped under the most frequent ones.

Words stand in a trie by how many letters of each letter group they have, group after group. One edit
takes at most one letter from one group and gives at most one to another, so a depth-first search
with a surplus and a deficit of one each reaches all words one edit away. The words of a leaf are
verified: one of their halves must stand unchanged in the word that is searched, then all letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.kernels import mix
from txnlens.operators.joins import lookup_join
from txnlens.session import materialize, shuffle_partitions

_LOWER = {c: c + 32 for c in range(65, 91)}
# One run in so many has a letter taken out, as a known rate of misspellings.
TYPO_RATE = 199
# Distinct words a task counts before it hands them on.
HELD_WORDS = 1 << 19
# Letter groups: common letters alone or with rare ones, so that each tells words apart; letters with
# marks go by their number.
GROUPS = ("aj", "ex", "iq", "oz", "uy", "tk", "nv", "rb", "sp", "hm", "lw", "dcfg")
# Words that a part of the trie should hold at most, and need not fall below; places searched at once.
PART_WORDS = 1 << 15
LEAST_PART = 1 << 9
FRONTIER = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _group_table() -> np.ndarray:
    table = np.arange(256) % len(GROUPS)
    for g, letters in enumerate(GROUPS):
        for c in letters:
            table[ord(c)] = g
    return table


def damaged(doc_id: int | None, run: str) -> str:
    """The run as it is counted: one in ``TYPO_RATE``, by a checksum of document and run, lacks a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % TYPO_RATE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with their counts; those beyond ``HELD_WORDS`` are handed on in between."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            found = Counter(runs.findall(text.translate(_LOWER)))
            begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            hit = [w for w in found if not zlib.crc32(w.encode(), begin) % TYPO_RATE]
            for word in hit:
                n = found.pop(word)
                if len(word) > least_length:
                    held[damaged(doc_id, word)] += n
            held.update(found)
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    yield out()


def _count_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = _Words(batch.column(0).to_pylist()).vectors()
        bounds = np.arange(len(counts) + 1, dtype=np.int32) * len(GROUPS)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.reshape(-1).astype(np.int32)))], ["counts"])


class _Words:
    """Words as flat letters, with hashes of all their prefixes."""

    def __init__(self, column: list[str]):
        self.text = column
        self.length = np.array([len(w) for w in column], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.letters = np.frombuffer("".join(column).encode("latin-1"), np.uint8)
        power = np.full(int(self.length.max(initial=0)) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        inverse = np.full(len(power), pow(int(_BASE), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        place = np.arange(len(self.letters)) - np.repeat(self.start[:-1], self.length)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.power[place] * (self.letters.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])

    def hash(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the letters from ``begin`` to ``end`` of each word."""
        at = self.start[word]
        return mix((self.sums[at + end] - self.sums[at + begin]) * self.inverse[begin] ^ (end - begin).astype(np.uint64))

    def vectors(self) -> np.ndarray:
        """How many letters of each group, a row a word."""
        cell = np.repeat(np.arange(len(self.length)), self.length) * len(GROUPS) + _group_table()[self.letters]
        return np.bincount(cell, minlength=len(self.length) * len(GROUPS)).reshape(-1, len(GROUPS))

    def near(self, longer: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether ``other`` comes from ``longer``, which has as many letters or one more, by exactly one edit."""
        result = np.zeros(len(longer), bool)
        size = self.length[other]
        width = 8
        todo = np.arange(len(longer))
        while len(todo):  # words of similar length at a time
            now, todo = todo[size[todo] <= width], todo[size[todo] > width]
            for at in range(0, len(now), max(1, (1 << 22) // width)):
                part = now[at : at + max(1, (1 << 22) // width)]
                a, b, n = longer[part], other[part], size[part]
                column = np.arange(width)
                inside = column < n[:, None]
                last = len(self.letters) - 1
                x = self.letters[np.minimum(self.start[a][:, None] + column, last)]
                y = self.letters[np.minimum(self.start[b][:, None] + column, last)]
                same = (x == y) | ~inside
                front = np.where(same.all(axis=1), n, same.argmin(axis=1))
                x = self.letters[np.maximum((self.start[a] + self.length[a])[:, None] - 1 - column, 0)]
                y = self.letters[np.maximum((self.start[b] + n)[:, None] - 1 - column, 0)]
                same = (x == y) | ~inside
                back = np.where(same.all(axis=1), n, same.argmin(axis=1))
                alike = self.length[a] == n
                result[part] = np.where(alike, (front + back == n - 1), front + back >= n)
            width *= 2
        return result


def search(words: list[str], first: np.ndarray, spent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(a, b)`` of places in ``words`` that are exactly one edit apart, each once.

    ``first`` is the node, ``depth`` groups deep, at which a word stands (``spent`` 0) or is searched
    with its deficit (1) or both (3) spent already; words that stand at one node agree in those groups.
    A search finds words with as many letters, or one less. Of two words with as many letters and
    different counts the one whose deficit comes first finds the other, of two with the same counts the
    one that comes first in ``words``.
    """
    column = _Words(words)
    vectors = column.vectors()
    indexed = np.flatnonzero(spent == 0)
    levels = vectors.shape[1]
    most = int(vectors.max(initial=0)) + 3
    # Nodes of each level are numbered in the order of their paths.
    keys, node = [], first[indexed]
    for level in range(depth, levels):
        key, node = np.unique(node * most + vectors[indexed, level], return_inverse=True)
        keys.append(key)
    # The words of each leaf by either half.
    size = column.length[indexed]
    halves = []
    for which, (begin, end) in enumerate(((np.zeros_like(size), size // 2), (size // 2, size))):
        key = mix(column.hash(indexed, begin, end) ^ mix(node.astype(np.uint64) * np.uint64(2) + np.uint64(which)))
        order = np.argsort(key, kind="stable")
        halves.append((key[order], indexed[order]))

    def leaf(q: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Verified words at the leaves ``at`` for the words ``q``."""
        size = column.length[q] - (state == 1)
        shift = column.length[q] - size
        cut = size // 2
        pairs = [np.zeros((0, 2), np.int64)]
        for which, (begin, end) in enumerate(((np.zeros_like(cut), cut), (cut + shift, size + shift))):
            key = mix(column.hash(q, begin, end) ^ mix(at.astype(np.uint64) * np.uint64(2) + np.uint64(which)))
            ordered, owner = halves[which]
            low = np.searchsorted(ordered, key, side="left")
            n = np.searchsorted(ordered, key, side="right") - low
            for start, stop in _blocks(n):
                rows = np.repeat(np.arange(start, stop), n[start:stop])
                within = np.arange(len(rows)) - np.repeat(np.cumsum(n[start:stop]) - n[start:stop], n[start:stop])
                a, b = q[rows], owner[low[rows] + within]
                keep = (column.length[b] == size[rows]) & ((state[rows] != 0) | (a < b))
                a, b = a[keep], b[keep]
                ok = column.near(a, b)
                pairs.append(np.stack([a[ok], b[ok]], axis=1))
        return np.unique(np.concatenate(pairs), axis=0)

    found = [np.zeros((0, 2), np.int64)]
    stack = [(depth, *(x[at : at + FRONTIER] for x in (np.arange(len(words)), first, spent))) for at in range(0, len(words), FRONTIER)]
    while stack:
        level, q, at, state = stack.pop()
        if level == levels:
            found.append(leaf(q, at, state))
            continue
        key, here = keys[level - depth], vectors[q, level]
        steps = []
        # As many letters of the group; one less, if that is unspent; one more, once one less is spent.
        for change, may, after in ((0, np.ones(len(q), bool), 0), (-1, (state == 0) & (here > 0), 1), (1, state == 1, 2)):
            wanted = at[may] * most + here[may] + change
            place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = key[place] == wanted if len(key) else np.zeros(len(wanted), bool)
            steps.append((q[may][hit], place[hit], state[may][hit] | after))
        q, at, state = (np.concatenate(x) for x in zip(*steps))
        stack += [(level + 1, q[i : i + FRONTIER], at[i : i + FRONTIER], state[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _blocks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose numbers add up to about ``FRONTIER``."""
    sums = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        stop = min(max(at + 1, int(np.searchsorted(sums, sums[at] + FRONTIER, side="right")) - 1), len(n))
        yield at, stop
        at = stop


_PLACED = "part binary, word string, n long, spent int"


def _place(depth: int):
    """Each word at its node ``depth`` groups deep, and at those where a search for it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _Words(batch.column(0).to_pylist()).vectors()[:, :depth]
            one = np.eye(depth, dtype=np.int64)
            moves = [(np.zeros(depth, np.int64), 0)]
            moves += [(-one[i], 1) for i in range(depth)]
            moves += [(one[j] - one[i], 3) for i in range(depth) for j in range(i + 1, depth)]
            for move, spent in moves:
                moved = counts + move
                rows = np.flatnonzero((moved >= 0).all(axis=1))
                cells = np.ascontiguousarray(moved[rows], dtype="<u4")
                part = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), len(rows), [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
                word, n = (c.take(pa.array(rows)) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([part, word, n, pa.array(np.full(len(rows), spent, np.int32))], ["part", "word", "n", "spent"])

    return run


_NEAR = "word string, n_near long, best_n long, best string"


def _near(placed: pa.Table) -> pa.Table:
    """For words of a bucket of nodes: how many words near them were found there, and the most frequent."""
    placed = placed.combine_chunks()
    first = placed["part"].chunk(0).dictionary_encode().indices.to_numpy().astype(np.int64)
    a, b = search(placed["word"].to_pylist(), first, placed["spent"].to_numpy().astype(np.int64), _depth_of(placed))
    coded = placed["word"].chunk(0).dictionary_encode()
    word, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    n = placed["n"].to_numpy()
    own, other, other_n = np.concatenate([word[a], word[b]]), np.concatenate([word[b], word[a]]), np.concatenate([n[b], n[a]])
    rank = np.empty(len(texts), np.int64)
    rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    order = np.lexsort((rank[other], -other_n, own))
    own, other, other_n = own[order], other[order], other_n[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    columns = [
        coded.dictionary.take(pa.array(own[begin])),
        pa.array(np.diff(np.append(begin, len(own))).astype(np.int64)),
        pa.array(other_n[begin].astype(np.int64)),
        coded.dictionary.take(pa.array(other[begin])),
    ]
    return pa.table(columns, [field.split(" ")[0] for field in _NEAR.split(", ")])


def _depth_of(placed: pa.Table) -> int:
    return len(placed["part"][0].as_py()) // 4


def count_words(docs: DataFrame, least_length: int = 6, least: int = 5) -> DataFrame:
    """``(word, n)``: words of at least so many letters and occurrences, some runs damaged as ``damaged`` says."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, least_length)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, best_n, best)`` for each row of ``(word, n)``, words being unique.

    Near words differ by exactly one letter put in, left out or replaced; ``best`` is the one of
    largest ``n``, the smallest in code-point order among equals. Words are runs of ``[a-zA-ZÀ-ÿ]``.
    """
    words = materialize(words, "words")
    vectors = words.mapInArrow(_count_groups, "counts array<int>")
    # As many groups lead to a part of the trie as it takes to make the parts small.
    depth = 0
    rows = most = words.count()
    partitions = shuffle_partitions(words.sparkSession)
    limit = min(PART_WORDS, max(LEAST_PART, rows // partitions))
    stored = materialize(vectors, "groups") if rows > limit else None
    while most > limit and depth < len(GROUPS):
        depth += 1
        most = stored.groupBy(F.slice("counts", 1, depth)).count().agg(F.max("count")).first()[0]
    depth = max(depth, 1)
    placed = words.mapInArrow(_place(depth), _PLACED)
    searches = 1 + depth + depth * (depth - 1) // 2
    buckets = max(partitions, rows * searches // (8 * PART_WORDS))
    bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket")
    near = placed.select(bucket, "part", "word", "n", "spent").groupBy("bucket").applyInArrow(_near, _NEAR)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    near = near.withColumn("n", F.lit(None).cast("long")).select(alone.columns)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("_n"), F.col("best"))))
    found = alone.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    return found.select("word", "n", "n_near", (-F.col("_best._n")).alias("best_n"), F.col("_best.best").alias("best"))


def group_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of the corpus.

    Words are runs of ``[A-Za-zÀ-ÿ]`` with A-Z in lower case, one in 199 of them without a letter (see
    ``damaged``); those of at least ``least_length`` letters and ``least`` occurrences count. A word's
    ``form`` is its most frequent near word if that occurs ``times`` as often, and ``root`` the end of
    the forms from there; a word without a form is its own root. Null texts have no words, a null
    ``doc_id`` is the empty text, repeated rows count again, and other columns are not looked at.
    """
    near = near_words(count_words(docs, least_length, least))
    often = F.col("best_n") >= times * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"))
    forms = materialize(forms, "forms")
    # Each step multiplies the number of occurrences, so chains are short; each round doubles the steps.
    most = forms.agg(F.max("n")).first()[0] or 0
    steps, n = 0, least
    while n * times <= most:
        steps, n = steps + 1, n * times
    links = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        links = materialize(links, "links")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = lookup_join(links, ahead, "root", how="left", spread="word").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    links = materialize(links, "links")
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
