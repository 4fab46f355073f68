"""The fraud metric block shared by all aggregates.

The four additive sums can be rolled up from any finer grain; the two ratios are always recomputed
from sums and never averaged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDITIVE = ("total_tx", "fraud_tx", "total_amount", "fraud_amount")
METRICS = ("total_tx", "fraud_tx", "fraud_rate", "total_amount", "fraud_amount", "fraud_share_by_value")


def additive_measures(is_fraud: Column, amt: Column) -> list[Column]:
    fraud = is_fraud == 1
    return [
        F.count(F.lit(1)).alias("total_tx"),
        F.sum(F.when(fraud, 1).otherwise(0)).alias("fraud_tx"),
        F.sum(amt).alias("total_amount"),
        F.sum(F.when(fraud, amt).otherwise(F.lit(0.0))).alias("fraud_amount"),
    ]


def rolled_up() -> list[Column]:
    """The additive measures of a coarser grain, from those of a finer one."""
    return [F.sum(name).alias(name) for name in ADDITIVE]


def ratio_columns() -> dict[str, Column]:
    """Ratios are null, not an error, where the denominator is zero."""
    return {
        "fraud_rate": F.try_divide(F.col("fraud_tx").cast("double"), F.col("total_tx")),
        "fraud_share_by_value": F.try_divide(F.col("fraud_amount"), F.col("total_amount")),
    }


def fraud_metrics(is_fraud: Column, amt: Column) -> list[Column]:
    """The whole block as aggregate expressions for one ``agg`` call."""
    total, fraud, amount, fraud_amount = additive_measures(is_fraud, amt)
    return [
        total,
        fraud,
        F.try_divide(fraud.cast("double"), total).alias("fraud_rate"),
        amount,
        fraud_amount,
        F.try_divide(fraud_amount, amount).alias("fraud_share_by_value"),
    ]
