"""Sources mixed to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is its source's repetition rate: the
target weight of the source over its share of the rows. The number is the inverse of the Poisson
distribution at a uniform number hashed from the id, so the same seed gives the same mix, and
documents are drawn without looking at each other. The copies are then shuffled globally.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.session import materialize

# Larger means are sums of parts of at most this mean, each with its own hash: exp() of it is far from 0.
PART_MEAN = 16.0
# The tail beyond this many terms is below what a uniform number of 52 bits can tell, for means up to PART_MEAN.
TERMS = 96
# Tables of rates up to this many sources are broadcast (at most some 1 KB each); larger ones are joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulative(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... of a Poisson variable."""
    first = F.exp(-mean)
    grow = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), F.array(first).alias("sums")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums")
        ),
    )
    return grow["sums"]


def invert(sums: Column, u: Column) -> Column:
    """The least k with u < P(X <= k)."""
    return F.size(F.filter(sums, lambda c: c <= u))


def tempered(sizes: DataFrame, alpha: float) -> DataFrame:
    """Target weights ``size ** alpha``: 1 keeps the shares of the sources, 0 makes them even."""
    return sizes.select("source", "n", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("weight"))


def rates(docs: DataFrame, weights: Mapping[str, float] | float, total: float | None = None) -> DataFrame:
    """``(source, rate)``: copies that a document of the source has on average, so that the mix has ``total`` rows
    (as many as ``docs`` if not given). Null is a source of its own; sources without a weight get rate 0."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(weights, Mapping):
        bad = [s for s, w in weights.items() if not 0 <= w < float("inf")]
        if bad:
            raise ValueError(f"weights must be finite and not negative: {bad}")
        given = docs.sparkSession.createDataFrame([(s or "", float(w)) for s, w in weights.items()], "source string, weight double")
        weighed = sizes.join(given, "source", "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        weighed = tempered(sizes, weights)
    weighed = materialize(weighed, "weights")
    rows, weight = weighed.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(rows or 0) if total is None else float(total)
    return weighed.select("source", F.when(F.lit(weight or 0.0) > 0, F.lit(wanted) * F.col("weight") / F.lit(weight or 1.0) / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] | float, total: float | None = None, seed: int = 0) -> DataFrame:
    """Columns of ``docs`` and ``copy`` (1, 2, ...): the documents repeated to the target weights, globally shuffled.

    ``weights`` maps sources to weights, or is the exponent of ``tempered``. Every row of a document
    that is repeated in ``docs`` has the same number of copies; rows without id are told apart by
    their texts. A null or empty source is one source of its own. ``copy`` replaces a column of that
    name. An empty table gives an empty mix. The order of the rows inside and across the partitions
    written is that of a hash of row, copy and seed.
    """
    table = rates(docs, weights, total).filter("rate > 0")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int"))
    table = table.select("source", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    table = table.select("source", "parts", cumulative(F.col("mean")).alias("sums"))
    no_id = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    id_text = F.coalesce(F.col("doc_id").cast("string"), no_id)
    row = docs.select(F.struct("*").alias("row"), id_text.alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    if table.count() <= BROADCAST_SOURCES:
        placed = row.join(F.broadcast(table), "source")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = row.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"])
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: invert(F.col("sums"), uniform(F.lit(str(seed)), F.col("id"), k.cast("string"))))
    counted = placed.select("row", "id", F.aggregate(draws, F.lit(0), lambda a, x: a + x).alias("n")).filter("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.xxhash64("row").cast("string"), F.lit("place"), F.col("copy")))
    placed = copies.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "copy"], "copy")
