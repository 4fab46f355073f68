"""Dense row numbers and surrogate keys without a global window.

A frame has no order of its own, so every operator takes the column(s) that carry it (``ord``);
they must be unique together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from txnlens.session import materialize

# monotonically_increasing_id() keeps the partition above bit 33 and the row within it below.
_ROW_BITS = 33


def row_ids(df: DataFrame, ord: str | Sequence[str], id_name: str = "transaction_id") -> DataFrame:
    """Number the rows 1..n in ``ord`` order.

    The rows are range-partitioned and stored once with their place inside the partition; running
    sums of the partition sizes then turn places into numbers. The store matters: sampled range bounds may differ between two evaluations of the same plan.
    """
    cols = [ord] if isinstance(ord, str) else list(ord)
    placed = (
        df.repartitionByRange(*cols)  # adaptive execution may merge neighbouring ranges
        .sortWithinPartitions(*cols)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(placed, "rows").withColumns(
        {
            "_part": F.shiftright("_place", _ROW_BITS),
            "_row": F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1),
        }
    )
    # As many rows as partitions, whatever the size of the data; counted once.
    sizes = sorted(tuple(r) for r in stored.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before = accumulate([size for _, size in sizes], initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(part, n) for (part, _), n in zip(sizes, before)], "_part bigint, _before bigint"
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(id_name, F.col("_before") + F.col("_row") + 1)
        .select(id_name, *df.columns)
    )


# Order of rows as ``transactions.union_splits`` gives it to rows read from files.
FILE_ORDER = "struct<split_no:int,place:struct<file:string,block:bigint,row:bigint>>"


def sums_before(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """Add ``_before``: the sum of ``value`` over the rows before, in ``order``.

    Ranges of rows are added up one by one, the sums inside a range by a window over it.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # As many rows as partitions.
    sums = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.sum(value)).collect())
    starts = accumulate([n for _, n in sums], initial=0)
    offsets = df.sparkSession.createDataFrame([(part, n) for (part, _), n in zip(sums, starts)], "_range int, _start bigint")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return materialize(ranged.join(F.broadcast(offsets), "_range").withColumn("_before", added), "sums")


def file_row_ids(df: DataFrame, ord: str, id_name: str = "transaction_id") -> DataFrame:
    """``row_ids`` for rows that still come as read from files.

    A task reads a file block from start to end, so the place in the block is known and only the
    block sizes need adding up: the rows are stored once where they are, neither sampled, sorted
    nor shuffled. If rows of a block are missing by now, the general way is taken.
    """
    stored = materialize(df, "rows")
    placed = stored.withColumns(
        {
            "_split": F.col(f"{ord}.split_no"),
            "_file": F.col(f"{ord}.place.file"),
            "_block": F.col(f"{ord}.place.block"),
            "_row": F.col(f"{ord}.place.row"),
        }
    )
    block = ["_split", "_file", "_block"]
    sizes = materialize(
        placed.groupBy(*block).agg(
            F.min("_row").alias("_first"), F.max("_row").alias("_last"), F.count(F.lit(1)).alias("_size")
        ),
        "blocks",
    )
    if sizes.filter(F.col("_last") - F.col("_first") + 1 != F.col("_size")).take(1):
        return row_ids(stored, ord, id_name)
    offsets = sums_before(sizes, block, "_size").select(*block, "_first", "_before")
    offsets = F.broadcast(offsets) if table_bytes(offsets) <= BROADCAST_BYTES else offsets
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return placed.join(offsets, block).withColumn(id_name, number).select(id_name, *df.columns)


def numbered_rows(df: DataFrame, ord: str | Sequence[str], id_name: str = "transaction_id") -> DataFrame:
    """Number the rows 1..n in ``ord`` order, the cheap way where the order is that of the files."""
    if isinstance(ord, str) and df.schema[ord].dataType.simpleString() == FILE_ORDER:
        return file_row_ids(df, ord, id_name)
    return row_ids(df, ord, id_name)


@dataclass(frozen=True)
class KeyTable:
    """``keys`` is ``(column, id, first_ord, n_rows)``; the sizes say how to join it."""

    keys: DataFrame
    n_keys: int
    n_rows: int
    n_bytes: int


def key_tables(df: DataFrame, keys: Mapping[str, str], ord: str) -> dict[str, KeyTable]:
    """Surrogate keys of several columns from one pass: ``{id_name: column}`` to ``{id_name: table}``.

    Ids are 1..n by first appearance, a null key gets 0. Rows are reduced to one per key before
    they move, so neither a hot key nor the number of rows matters; the distinct keys of all
    columns are then numbered together, in parallel.
    """
    cols = list(keys.values())
    found = df.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id().alias("_set"), F.min(ord).alias("first_ord"), F.count(F.lit(1)).alias("n_rows")
    )
    no_key = F.lit(True)
    for c in cols:
        no_key = no_key & F.col(c).isNull()
    # The null key sorts last in its set, so it takes no number from the others.
    numbered = materialize(row_ids(found.withColumn("_null", no_key), ["_set", "_null", "first_ord"], "_id"), "keys")
    # One row per column numbered. A key takes its text and two numbers.
    width = F.lit(48)
    for c in cols:
        width = width + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    sizes = numbered.groupBy("_set").agg(F.min("_id"), F.count(F.lit(1)), F.sum("n_rows"), F.sum(width.cast("long"))).collect()
    by_set = {row[0]: row[1:] for row in sizes}
    out = {}
    for place, (id_name, c) in enumerate(keys.items()):
        # grouping_id() has a bit for each column left out, the first one highest.
        bits = (1 << len(cols)) - 1 - (1 << (len(cols) - 1 - place))
        start, n_keys, n_rows, n_bytes = by_set.get(bits, (1, 0, 0, 0))
        number = F.when(F.col("_null"), F.lit(0)).otherwise(F.col("_id") - start + 1)
        table = numbered.filter(F.col("_set") == bits).select(c, number.alias(id_name), "first_ord", "n_rows")
        out[id_name] = KeyTable(table, n_keys, n_rows, n_bytes)
    return out


def surrogate_keys(df: DataFrame, key: str, ord: str, id_name: str) -> KeyTable:
    """Surrogate key of one column, see ``key_tables``."""
    return key_tables(df, {id_name: key}, ord)[id_name]


def continue_keys(table: KeyTable, key: str, id_name: str, stored: DataFrame) -> tuple[KeyTable, KeyTable]:
    """Key table of a further load: all its keys, and those that are new.

    ``stored`` has the known keys ``(key, id)``. They keep their ids; new ones are numbered on from the
    greatest by first appearance, a new null key gets 0. Both sides have a key once, so the join has
    no heavy keys.
    """
    known = stored.select(F.col(key).alias("_known"), F.col(id_name).alias("_old"))
    found = table.keys.drop(id_name).join(known, F.col(key).eqNullSafe(F.col("_known")), "left")
    found = materialize(found.select(key, "first_ord", "n_rows", "_old"), "keys")
    last = stored.agg(F.max(id_name)).first()[0] or 0
    fresh = found.filter(F.col("_old").isNull()).drop("_old")
    numbered = row_ids(fresh.filter(F.col(key).isNotNull()), "first_ord", id_name).withColumn(id_name, F.col(id_name) + last)
    new = numbered.unionByName(fresh.filter(F.col(key).isNull()).withColumn(id_name, F.lit(0).cast("long")))
    new = new.select(key, id_name, "first_ord", "n_rows")
    old = found.filter(F.col("_old").isNotNull()).select(key, F.col("_old").alias(id_name), "first_ord", "n_rows")
    sizes = (table.n_keys, table.n_rows, table.n_bytes)
    return KeyTable(old.unionByName(new), *sizes), KeyTable(new, *sizes)


def attach_key(df: DataFrame, table: KeyTable, key: str, id_name: str, ord: str) -> DataFrame:
    """Add the surrogate key of each row's natural key; rows with a null key get 0."""
    known = table.keys.filter(F.col(key).isNotNull()).select(key, id_name, "n_rows")
    out = lookup_join(
        df, known, key, how="left", spread=ord, weight="n_rows", dim_bytes=table.n_bytes, fact_rows=table.n_rows
    )
    return out.withColumn(id_name, F.coalesce(F.col(id_name), F.lit(0)))


def first_per_key(df: DataFrame, table: KeyTable, ord: str, cols: Sequence[str]) -> DataFrame:
    """Attributes of the first row of every key.

    The key table already holds that row's ``ord``, so this is a join on a unique column: no group of
    rows is ever gathered, and small key tables leave the rows where they are.
    """
    first = table.keys.drop("n_rows").withColumnRenamed("first_ord", ord)
    return first.join(df.select(ord, *cols), ord).drop(ord)
