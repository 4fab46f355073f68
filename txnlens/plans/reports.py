"""Standard reports over the star and its aggregates.

Where the order is by a rate, groups without a rate come first and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.star import Star


def monthly_trend(monthly: DataFrame) -> DataFrame:
    return monthly.orderBy("year", "month").select("year_month", "fraud_rate")


def daily_head(daily: DataFrame, n: int = 5) -> DataFrame:
    return daily.orderBy("trans_date").limit(n)


def _top(aggregate: DataFrame, key: str, name: str, n: int) -> DataFrame:
    ordered = aggregate.orderBy(F.col("fraud_rate").desc_nulls_first(), key)
    return ordered.limit(n).select(name, "total_tx", "fraud_tx", "fraud_rate")


def top_merchants(merchant: DataFrame, n: int = 10) -> DataFrame:
    return _top(merchant, "merchant_id", "merchant_name", n)


def top_categories(category: DataFrame, n: int = 10) -> DataFrame:
    return _top(category, "category_id", "category_name", n)


def entity_ranking(merchant: DataFrame, category: DataFrame, n: int = 10) -> DataFrame:
    """Merchants and categories in one ranking by rate, then by number of fraud cases."""

    def entities(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("entity_type"),
            F.col(f"{kind}_id").alias("entity_id"),
            F.col(f"{kind}_name").alias("entity_name"),
            "total_tx",
            "fraud_tx",
            "fraud_rate",
        )

    both = entities(merchant, "merchant").unionByName(entities(category, "category"))
    return both.orderBy(
        F.col("fraud_rate").desc_nulls_first(), F.col("fraud_tx").desc_nulls_first(), "entity_type", "entity_id"
    ).limit(n)


def last_fraud(star: Star, n: int = 10, tie_break: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """The latest fraud cases that have a customer and a merchant, with their names.

    A case whose customer or merchant has no dimension row drops out before the limit counts, so
    ``n`` cases come back if there are as many. Names are looked up for those alone, and each task
    passes on at most ``n`` rows.
    """
    extra = [c for c in tie_break if c not in ("customer_id", "merchant_id", "amt")]
    known = (
        star.fact.filter(F.col("is_fraud") == 1)
        .select("trans_ts", "amt", "is_fraud", "customer_id", "merchant_id", *extra)
        .join(star.customer.select("customer_id"), "customer_id", "left_semi")
        .join(star.merchant.select("merchant_id"), "merchant_id", "left_semi")
    )
    latest = known.orderBy(F.col("trans_ts").desc_nulls_first(), *tie_break).limit(n)
    people = star.customer.select(
        "customer_id", F.col("first").alias("customer_first"), F.col("last").alias("customer_last")
    )
    shops = star.merchant.select("merchant_id", "merchant_name")
    named = people.join(F.broadcast(latest), "customer_id")
    named = shops.join(F.broadcast(named), "merchant_id")
    ordered = named.orderBy(F.col("trans_ts").desc_nulls_first(), *tie_break).limit(n)
    return ordered.select("trans_ts", "customer_first", "customer_last", "merchant_name", "amt", "is_fraud")


def hourly_fraud(fact: DataFrame) -> DataFrame:
    cases = fact.filter(F.col("is_fraud") == 1)
    return cases.groupBy("hour").agg(F.avg("amt").alias("avg_fraud_amount"), F.count(F.lit(1)).alias("fraud_tx")).orderBy("hour")
