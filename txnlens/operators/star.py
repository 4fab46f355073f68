"""The star schema: four dimensions, one fact table, and the view that joins them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.features import calendar_columns, with_features
from txnlens.operators.joins import BROADCAST_BYTES, key_counts, lookup_join, table_bytes
from txnlens.operators.keys import KeyTable, attach_key, continue_keys, first_per_key, key_tables, numbered_rows
from txnlens.schemas import columns
from txnlens.session import materialize

CUSTOMER_ATTRIBUTES = columns("dim_customer")[2:]
FACT_COLUMNS = columns("fact_transactions")
DIMENSIONS = ("customer", "merchant", "category", "date")


@dataclass(frozen=True)
class Star:
    """The five tables. Dimension ``x`` is keyed by ``x_id``, which the fact table refers to."""

    customer: DataFrame
    merchant: DataFrame
    category: DataFrame
    date: DataFrame
    fact: DataFrame

    def dim(self, name: str) -> DataFrame:
        if name not in DIMENSIONS:
            raise ValueError(f"unknown dimension: {name}")
        return getattr(self, name)


def dim_customer(txn: DataFrame, keys: KeyTable, ord: str = "ord") -> DataFrame:
    """One row per card number, with the attributes of its first transaction."""
    return first_per_key(txn, keys, ord, CUSTOMER_ATTRIBUTES).select("customer_id", "cc_num", *CUSTOMER_ATTRIBUTES)


def dim_merchant(txn: DataFrame, keys: KeyTable, ord: str = "ord") -> DataFrame:
    """One row per merchant; its coordinates are those of its first transaction."""
    out = first_per_key(txn, keys, ord, ("merch_lat", "merch_long"))
    return out.select("merchant_id", F.col("merchant").alias("merchant_name"), "merch_lat", "merch_long")


def dim_category(keys: KeyTable) -> DataFrame:
    return keys.keys.select("category_id", F.col("category").alias("category_name"))


def dim_date(keys: KeyTable) -> DataFrame:
    """One row per day; all attributes follow from the day, so no transaction is read again."""
    names = ("year", "month", "day", "day_of_week", "is_weekend", "year_month")
    return keys.keys.select("date_id", "trans_date").withColumns(calendar_columns(F.col("trans_date"))).select(
        "date_id", "trans_date", *names
    )


# The column that identifies a row of each dimension, as transactions and as the dimension name it.
NATURAL_KEYS = {"customer": "cc_num", "merchant": "merchant", "category": "category", "date": "trans_date"}
STORED_KEYS = {"customer": "cc_num", "merchant": "merchant_name", "category": "category_name", "date": "trans_date"}


def star_keys(txn: DataFrame, ord: str = "ord") -> dict[str, KeyTable]:
    """Surrogate key tables of the four dimensions."""
    tables = key_tables(txn, {f"{name}_id": key for name, key in NATURAL_KEYS.items()}, ord)
    return {name: tables[f"{name}_id"] for name in NATURAL_KEYS}


def fact_transactions(txn: DataFrame, keys: dict[str, KeyTable]) -> DataFrame:
    """The fact table from numbered transactions with features."""
    needed = set(FACT_COLUMNS) - {f"{d}_id" for d in DIMENSIONS}
    fact = txn.select(*[c for c in FACT_COLUMNS if c in needed], *NATURAL_KEYS.values())
    for name, natural in NATURAL_KEYS.items():
        fact = attach_key(fact, keys[name], natural, f"{name}_id", "transaction_id").drop(natural)
    return fact.select(*FACT_COLUMNS)


def build_star(txn: DataFrame, ord: str | Sequence[str] = "ord") -> Star:
    """Star schema of a typed transaction frame.

    The transactions are numbered and stored once; keys, dimensions and fact read that table with
    only the columns they need, and use the dense number as their order. Features are derived from
    it where they are needed, so range sampling and store do not pay for them. The dimensions,
    small beside the fact, are stored as well, since every use of the star joins them.
    """
    numbered = with_features(numbered_rows(txn, ord, "transaction_id"))
    keys = star_keys(numbered, "transaction_id")
    return _star(numbered, keys, keys)


def extend_star(stored: Star, txn: DataFrame, ord: str | Sequence[str] = "ord") -> Star:
    """What a further load adds to a star: rows of new keys, and its transactions with old and new keys.

    Transactions are numbered on from the greatest stored number, keys as ``continue_keys`` says; of
    the stored star only the keys and the greatest number are read.
    """
    last = stored.fact.agg(F.max("transaction_id")).first()[0] or 0
    rows = numbered_rows(txn, ord, "transaction_id").withColumn("transaction_id", F.col("transaction_id") + last)
    numbered = with_features(rows)
    every, new = {}, {}
    for name, table in star_keys(numbered, "transaction_id").items():
        key, id_name = NATURAL_KEYS[name], f"{name}_id"
        known = stored.dim(name).select(F.col(STORED_KEYS[name]).alias(key), id_name)
        every[name], new[name] = continue_keys(table, key, id_name, known)
    return _star(numbered, every, new)


def _star(numbered: DataFrame, keys: dict[str, KeyTable], dimension_keys: dict[str, KeyTable]) -> Star:
    return Star(
        customer=materialize(dim_customer(numbered, dimension_keys["customer"], "transaction_id"), "dim_customer"),
        merchant=materialize(dim_merchant(numbered, dimension_keys["merchant"], "transaction_id"), "dim_merchant"),
        category=materialize(dim_category(dimension_keys["category"]), "dim_category"),
        date=materialize(dim_date(dimension_keys["date"]), "dim_date"),
        fact=fact_transactions(numbered, keys),
    )


def star_view(star: Star, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The fact joined with the given dimensions; the fact's own date parts win over the dimension's.

    Dimensions that are too large to broadcast have their keys counted in one pass over the fact.
    """
    taken, tables = set(star.fact.columns), {}
    for name in dims:
        dim = star.dim(name)
        tables[name] = dim.drop(*[c for c in dim.columns if c in taken and c != f"{name}_id"])
        taken |= set(tables[name].columns)
    size = {name: table_bytes(dim) for name, dim in tables.items()}
    large = [f"{name}_id" for name in dims if size[name] > BROADCAST_BYTES]
    counts = key_counts(star.fact, large) if large else {}
    out = star.fact
    for name, dim in tables.items():
        key = f"{name}_id"
        weight = "_rows" if key in counts else None
        out = lookup_join(out, dim.join(counts[key], key) if weight else dim, key, weight=weight, dim_bytes=size[name])
    return out
