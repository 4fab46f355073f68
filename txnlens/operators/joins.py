"""Join of a large table with a table that is unique on the join column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.session import materialize, shuffle_partitions

# Lookup tables of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def table_bytes(df: DataFrame) -> int:
    """About the bytes of a table as rows: texts by their length, nested values as JSON, others as 8 bytes."""
    size = F.lit(16)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(value), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            size = size + 16 + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def key_counts(facts: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """``(key, _rows)`` for each of several columns, counted in one pass and stored."""
    counted = facts.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows"))
    stored = materialize(counted, "counts")
    bit = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    return {k: stored.filter((F.col("_set") == bit[k]) & F.col(k).isNotNull()).select(k, "_rows") for k in keys}


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "inner",
    spread: str = "transaction_id",
    weight: str | None = None,
    dim_bytes: int | None = None,
    fact_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``facts JOIN dim USING (on)`` (inner or left), safe when one key holds much of ``facts``.

    A ``dim`` of at most ``broadcast_bytes`` is broadcast and ``facts`` stay where they are. For a larger one, keys with more rows than an even share of a
    shuffle partition are looked up in a broadcast table, which holds at most as many keys as
    there are partitions; their rows then bypass the shuffle join spread by a hash of the
    ``spread`` column instead of piling up in one task. ``weight`` names a column of ``dim`` with
    the number of fact rows per key; it is not part of the result. Sizes that are known need not be
    found here.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    payload = [c for c in dim.columns if c not in (on, weight)]
    known = table_bytes(dim.select(on, *payload)) if dim_bytes is None else dim_bytes
    if known <= broadcast_bytes:
        return facts.join(F.broadcast(dim.select(on, *payload)), on, how)

    if weight is None:
        counts = facts.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
        dim, weight = dim.join(counts, on), "_rows"
    parts = shuffle_partitions(facts.sparkSession)
    total = dim.agg(F.sum(weight)).first()[0] or 0 if fact_rows is None else fact_rows
    value = F.struct(*payload)
    hot = dim.filter(F.col(weight) > total / parts).select(on, value.alias("_hot"))
    rest = dim.filter(F.col(weight) <= total / parts).select(
        F.col(on).alias("_key"), F.xxhash64(on).alias("_salt"), value.alias("_cold")
    )
    # Rows already served, and rows with a null key, match nothing below: their key is null.
    marked = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(on))
    )
    # The salt is computed on both sides: a constant would be folded out of the join keys.
    salt = F.when(F.col("_key").isNull(), F.xxhash64(spread)).otherwise(F.xxhash64("_key"))
    marked = marked.withColumn("_salt", salt)
    joined = marked.join(rest, ["_key", "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.filter(F.col("_value").isNotNull())
    return joined.select(on, *[c for c in facts.columns if c != on], *[F.col(f"_value.{c}").alias(c) for c in payload])
