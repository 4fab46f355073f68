"""Fraud aggregates by day, month, merchant and category."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.measures import ADDITIVE, METRICS, additive_measures, ratio_columns, rolled_up
from txnlens.operators.star import Star
from txnlens.session import materialize

# grain -> (dimension joined, group columns)
GRAINS = {
    "daily": (
        "date", ("trans_date", "year", "month", "day", "day_of_week", "is_weekend", "year_month"),
    ),
    "monthly": ("date", ("year", "month", "year_month")),
    "merchant": ("merchant", ("merchant_id", "merchant_name")),
    "category": ("category", ("category_id", "category_name")),
}


def agg_fraud(star: Star, grain: str, key: str | None = None) -> DataFrame:
    """The metric block per group.

    ``key`` is the column that fact and dimension share, by default the dimension's id.

    The fact is reduced to one row per foreign key before the join, so only the partial sums are
    shuffled and a hot key costs no more than any other; the join and the final roll-up work on
    dimension-sized input. Facts without a dimension row drop out, as in the join they stand for.
    """
    name, groups = GRAINS[grain]
    key = key or f"{name}_id"
    sums = star.fact.groupBy(key).agg(*additive_measures(F.col("is_fraud"), F.col("amt")))
    dim = star.dim(name).select(key, *[c for c in groups if c != key])
    return with_ratios(sums.join(dim, key).groupBy(*groups).agg(*rolled_up()), groups)


def partial_sums(star: Star, keys: Mapping[str, str]) -> DataFrame:
    """Sums of the fact by each of several columns, from one pass: ``(_set, keys, additive measures)``.

    ``keys`` maps dimensions to the columns that refer to them. Rows are reduced to one per key of
    each column where they are read; ``_set`` tells the columns apart (see ``key_bit``).
    """
    columns = list(keys.values())
    measures = additive_measures(F.col("is_fraud"), F.col("amt"))
    return star.fact.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_set"), *measures)


def key_bit(columns: list[str], column: str) -> int:
    """``_set`` of a column: a bit for each column left out, the first one highest."""
    return (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - columns.index(column)))


def agg_all(star: Star, keys: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """All four aggregates from one scan of the fact, monthly from daily; see ``agg_fraud``."""
    keys = dict(keys or {name: f"{name}_id" for name in ("date", "merchant", "category")})
    columns = list(keys.values())
    sums = materialize(partial_sums(star, keys), "sums")
    out = {}
    for grain, (name, groups) in GRAINS.items():
        key = keys[name]
        if grain == "monthly":
            continue
        dim = star.dim(name).select(key, *[c for c in groups if c != key])
        mine = sums.filter(F.col("_set") == key_bit(columns, key)).select(key, *ADDITIVE)
        out[grain] = with_ratios(mine.join(dim, key).groupBy(*groups).agg(*rolled_up()), groups)
    out["daily"] = materialize(out["daily"], "daily")
    out["monthly"] = rollup_daily_to_monthly(out["daily"])
    return out


def with_ratios(sums: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return sums.withColumns(ratio_columns()).select(*groups, *METRICS)


def rollup_daily_to_monthly(daily: DataFrame) -> DataFrame:
    """Monthly aggregate from a stored daily one: sums are added, ratios computed anew."""
    _, groups = GRAINS["monthly"]
    return with_ratios(daily.groupBy(*groups).agg(*rolled_up()), groups)


def metrics(star: Star, grain: str, stored: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A stored aggregate if there is one, else a roll-up of the stored daily one, else computed."""
    stored = stored or {}
    if grain in stored:
        return stored[grain]
    if grain == "monthly" and "daily" in stored:
        return rollup_daily_to_monthly(stored["daily"])
    return agg_fraud(star, grain)
