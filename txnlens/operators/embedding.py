"""Texts to vectors. The encoder is a plug-in; the default needs no model."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.text import all_terms
from txnlens.functions.vector import l2_normalize

DIM = 768
BATCH_SIZE = 32
# Counts a task works on at a time.
HISTOGRAM_CELLS = 1 << 22
ROLES = ("query", "passage")

# The workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Built once per Python worker; maps a list of texts to a matrix with one row per text.
Encoder = Callable[[list[str]], np.ndarray]


def with_role(text: Column, role: str) -> Column:
    """The prefix by which an encoder tells questions from passages."""
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    return F.concat(F.lit(f"{role}: "), F.coalesce(text, F.lit("")))


def embed(
    df: DataFrame,
    text_col: str = "text",
    role: str = "passage",
    make_encoder: Callable[[], Encoder] | None = None,
    dim: int = DIM,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add the unit-length ``vector`` of each text; null where the encoder gives a zero vector.

    Without ``make_encoder`` the vector counts words by a part of their MD5.
    """
    text = with_role(F.col(text_col), role)
    if make_encoder is None:
        raw = _histogram(all_terms(text), dim)
    else:
        raw = _encoder_udf(make_encoder, batch_size)(text)
    return df.withColumn("_raw", raw).withColumn("vector", l2_normalize(F.col("_raw"))).select(*df.columns, "vector")


def word_bucket(word: str, dim: int) -> int:
    """Place of a word in the vector: the first 32 bits of its MD5, modulo ``dim``."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big") % dim


def _histogram(words: Column, dim: int) -> Column:
    """How often words of each place occur in a row's list; a distinct word of a batch is hashed once."""

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        places = np.array([word_bucket(w, dim) for w in coded.dictionary.to_pylist()], np.int64)
        values = places[coded.indices.to_numpy()]
        out = []
        step = max(1, HISTOGRAM_CELLS // dim)
        cuts = np.searchsorted(row, np.arange(0, len(lists) + step, step))
        for k, first in enumerate(range(0, len(lists), step)):
            n = min(step, len(lists) - first)
            mine = slice(cuts[k], cuts[k + 1])
            out.append(np.bincount((row[mine] - first) * dim + values[mine], minlength=n * dim).astype(np.float32))
        flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.float32))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), flat)

    return run(words)


def _encoder_udf(make_encoder: Callable[[], Encoder], batch_size: int):
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch_size):
                rows.extend(np.asarray(encoder(texts.iloc[at : at + batch_size].tolist()), dtype=np.float32))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return encode
