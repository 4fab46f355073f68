"""Toxicity of documents: subword bags, averaged, under a linear softmax.

A word is the bag of its character n-grams and itself, hashed to rows of an embedding table; a span
of words is the mean of its words' means, and a softmax over two classes reads it. Table and softmax
are trained together in NumPy. Misspelled words share most n-grams with the words they stand for.

A toxic document need not be toxic all over: its score is that of its most toxic span, and training
goes on with the spans that score highest, so length does not water anything down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5)
SPAN = 2
# Rows of each class and bytes of text that a model is fitted on at most.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 48 << 20
# Scores of words that a task remembers; when full it starts anew.
MEMO = 1 << 18
# Characters of text scored at a time.
PIECE = 1 << 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` pairs: every word's n-grams, with marks at its ends, and the whole word."""
    marked = [f"<{w}>" for w in vocabulary]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    end = np.repeat(np.cumsum(size), size)
    base = np.uint64(0x100000001B3)
    out_word, out_hash = [], []
    value = np.full(len(letters), 0xCBF29CE484222325, dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(letters) - n + 1
        if m <= 0:
            break
        value = value[:m] * base ^ letters[n - 1 : n - 1 + m]
        if n in NGRAMS:
            whole = np.arange(m) + n <= end[:m]
            out_word.append(word[:m][whole])
            out_hash.append(value[whole] + np.uint64(n))
    starts = np.cumsum(size) - size
    place = (np.arange(len(letters)) - np.repeat(starts, size)).astype(np.uint64)
    mixed = (letters + np.uint64(1)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    if len(starts):
        out_word.append(np.arange(len(marked)))
        out_hash.append(np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts))
    h = np.concatenate(out_hash) if out_hash else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(out_word) if out_word else np.zeros(0, np.int64), ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """What scoring needs of a trained model: the share of each bucket in the difference of the two logits."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, vocabulary: list[str]) -> np.ndarray:
        word, bucket = subwords(vocabulary)
        n = np.bincount(word, minlength=len(vocabulary))
        return np.bincount(word, self.weight[bucket], len(vocabulary)) / np.maximum(n, 1)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        """0 for a logit of minus infinity."""
        found = np.isfinite(logit)
        out = np.zeros(len(logit))
        out[found] = 1 / (1 + np.exp(-np.clip(self.slope * logit[found] + self.shift, -60, 60)))
        return out


def span_means(scores: np.ndarray) -> np.ndarray:
    """Means of all spans of a text that has words; a shorter text is one span."""
    if len(scores) <= SPAN:
        return np.array([scores.mean()])
    sums = np.cumsum(np.append(0.0, scores))
    return (sums[SPAN:] - sums[:-SPAN]) / SPAN


def _listed(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one word after the other, and where each begins; some words at a time."""
    buckets, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for first in range(0, len(vocabulary), 1 << 14):
        part = vocabulary[first : first + (1 << 14)]
        word, bucket = subwords(part)
        buckets.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
        counts.append(np.bincount(word, minlength=len(part)))
    return np.concatenate(buckets), np.append(0, np.cumsum(np.concatenate(counts)))


def train(texts: list[str], labels: np.ndarray, prior: float, epochs: int = 24, seed: int = 7) -> Model:
    """Fit table and softmax to labelled texts; ``prior`` is the share of label 1 the scores are set for."""
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words(t)], dtype=np.int32) for t in texts]
    labels = labels[[i for i, d in enumerate(docs) if len(d)]]
    docs = [d for d in docs if len(d)]  # without words there is nothing to learn
    bucket, cuts = _listed(list(known))
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    table_sq, soft_sq, bias_sq = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)

    def best() -> tuple[np.ndarray, np.ndarray]:
        """Start of the highest span of each text, and its logit."""
        weight = table @ (soft[:, 1] - soft[:, 0])
        score = np.add.reduceat(weight[bucket], cuts[:-1]) / np.diff(cuts) if len(bucket) else np.zeros(0)
        means = [span_means(score[d]) for d in docs]
        at = np.array([int(m.argmax()) for m in means])
        return at, np.array([m[k] for m, k in zip(means, at)]) + (bias[1] - bias[0])

    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for epoch in range(epochs if docs else 0):
        top, _ = best()
        spans = []
        for i, d in enumerate(docs):
            last = max(1, len(d) - SPAN + 1)
            starts = list(rng.integers(0, last, 6)) if epoch < 2 else [top[i], *rng.integers(0, last, 0 if labels[i] else 3)]
            spans += [(i, int(s)) for s in starts]
        rng.shuffle(spans)
        for first in range(0, len(spans), 512):
            batch = spans[first : first + 512]
            members = [docs[i][s : s + SPAN] for i, s in batch]
            size = np.array([len(m) for m in members])
            of_span = np.repeat(np.arange(len(batch)), size)
            ids = np.concatenate(members)
            count = cuts[ids + 1] - cuts[ids]
            entry = np.repeat(cuts[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            rows = bucket[entry]
            share = np.repeat(1.0 / (count * size[of_span]), count)
            target = np.repeat(of_span, count)
            mean = np.stack([np.bincount(target, table[rows, k] * share, len(batch)) for k in range(DIM)], axis=1)
            logits = mean @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            y = labels[[i for i, _ in batch]]
            error = p
            error[np.arange(len(batch)), y] -= 1
            error *= balance[[i for i, _ in batch]][:, None] / len(batch)
            to_mean = error @ soft.T
            for grad, value, square in ((mean.T @ error, soft, soft_sq), (error.sum(axis=0), bias, bias_sq)):
                square += grad * grad
                value -= 0.05 * grad / np.sqrt(square)
            touched, place = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(place, to_mean[target, k] * share, len(touched)) for k in range(DIM)], axis=1)
            table_sq[touched] += (grad * grad).mean(axis=1)
            table[touched] -= 0.3 * grad / np.sqrt(table_sq[touched])[:, None]
    # Scale of the highest spans' logits, fitted by logistic regression.
    _, logit = best() if len(docs) else (None, np.zeros(0))
    share = labels.mean() if len(labels) else 0.5
    importance = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    slope, shift = 1.0, 0.0
    for _ in range(300 if len(labels) and 0 < share < 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -60, 60)))
        g, h = importance * (p - labels), importance * np.maximum(p * (1 - p), 1e-6)
        a, b, c = (h * logit * logit).sum() + 1e-3, (h * logit).sum(), h.sum() + 1e-3
        ga, gb = (g * logit).sum() + 1e-3 * (slope - 1), g.sum()
        det = a * c - b * b
        step = np.array([c * ga - b * gb, a * gb - b * ga]) / max(det, 1e-12)
        step *= min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    weight = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return Model(weight, float(bias[1] - bias[0]), float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Fit a model on labelled documents: at most ``rows`` of each class and ``size`` bytes, picked by a hash of the id.

    Rows without id, text or label teach nothing; of repeated ids every row may be picked. Without
    both classes, every text scores the same.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    place = F.xxhash64("doc_id", F.lit("sample"))
    picked = []
    for label in (0, 1):
        mine = known.filter(F.col("toxic") == label).orderBy(place, "doc_id").limit(rows)
        picked.append(mine)
    sample = picked[0].unionByName(picked[1])  # bounded by the parameter
    sizes = slim.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id", F.lit("mix")), "doc_id").limit(2 * rows).collect()
    total, ids = 0, set()
    for r in sizes:
        if total + r["size"] <= size:
            total += r["size"]
            ids.add(r["doc_id"])
    spark = docs.sparkSession
    chosen = sample.filter(F.col("doc_id").isin(sorted(ids))) if len(ids) < 50 else sample.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")), "doc_id")
    # Repeated rows of an id count once, and of several texts under one id the same ones are taken in every run.
    texts = slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").distinct()
    first = texts.orderBy(F.xxhash64("doc_id", "text", F.lit("text")), "doc_id", "text", "toxic").limit(2 * rows)
    found = sorted((r["doc_id"], r["toxic"], r["text"]) for r in first.collect())
    y = np.array([t for _, t, _ in found], dtype=np.int64)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return train([text for _, _, text in found], y, min(max(prior, 0.01), 0.99))


def pieces(batch: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``PIECE`` characters each."""
    first, size = 0, 0
    for i, text in enumerate(batch):
        size += len(text) if text else 0
        if size >= PIECE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(batch):
        yield first, len(batch)


def score(model: Model, text: Column, spark) -> Column:
    """Column with the toxicity of ``text``, 0 to 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value
        memo: dict[str, float] = {}
        for batch in batches:
            out = np.empty(len(batch))
            for first, last in pieces(batch):
                found = [words(v) if v else [] for v in batch.iloc[first:last]]
                seen = set().union(*found)
                new = [w for w in seen if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = list(seen)
                memo.update(zip(new, one.word_scores(new).tolist()))
                out[first:last] = [span_means(np.array([memo[w] for w in f])).max() if f else -np.inf for f in found]
            yield pd.Series(one.probability(out + one.bias))

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row, over the whole text.

    Learns from the labels of the rows that are not held out. Labels, languages, sources and ids are
    no input of a score. Texts without words, such as null ones, have nothing toxic and score 0.
    Rows keep their ``doc_id``, null or repeated; other columns are not looked at.
    """
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``threshold``; see ``score_toxicity``."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return docs.filter(score(model, F.col("text").cast("string"), docs.sparkSession) < threshold)
