"""Fraud metrics by any columns, from the smallest stored aggregate that has enough detail."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.measures import ADDITIVE, additive_measures, rolled_up
from txnlens.operators.aggregates import with_ratios
from txnlens.operators.star import DIMENSIONS, Star

# Conditions on columns: each a function of its column.
Conditions = Mapping[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class Aggregate:
    """A stored aggregate: its group columns, and its number of rows, which says what reading it costs."""

    name: str
    frame: DataFrame
    groups: frozenset[str]
    rows: int


def catalog(stored: Mapping[str, DataFrame]) -> list[Aggregate]:
    """Stored aggregates with their sizes; every column that is not a measure is a group column."""
    measures = {*ADDITIVE, "fraud_rate", "fraud_share_by_value"}
    out = []
    for name, frame in stored.items():
        if not set(ADDITIVE) <= set(frame.columns):
            continue  # ratios alone cannot be added up
        out.append(Aggregate(name, frame, frozenset(frame.columns) - measures, frame.count()))
    return out


def smallest(aggregates: Sequence[Aggregate], groups: Sequence[str], where: Conditions | None = None) -> Aggregate | None:
    """The smallest aggregate that tells apart all that is asked for, if there is one.

    Its group columns must have those of the question and of its conditions: rows of a finer
    aggregate add up to those of a coarser one, and a condition on a group column keeps or drops
    whole rows. Ties go to the name.
    """
    needed = {*groups, *(where or {})}
    enough = [a for a in aggregates if needed <= a.groups]
    return min(enough, key=lambda a: (a.rows, a.name), default=None)


def _filtered(df: DataFrame, where: Conditions | None) -> DataFrame:
    return reduce(lambda d, c: d.filter(c[1](F.col(c[0]))), (where or {}).items(), df)


def metrics_by(
    star: Star,
    groups: Sequence[str],
    where: Conditions | None = None,
    aggregates: Sequence[Aggregate] = (),
    keys: Mapping[str, str] | None = None,
) -> DataFrame:
    """The metric block by ``groups``, under conditions on columns.

    Answered from the smallest sufficient aggregate, without a look at the fact; else from the star
    (see ``from_star``). Sums are added, ratios always computed from sums. Groups come out once each,
    null is a group of its own.
    """
    found = smallest(aggregates, groups, where)
    if found is None:
        return from_star(star, groups, where, keys)
    return with_ratios(_filtered(found.frame, where).groupBy(*groups).agg(*rolled_up()), tuple(groups))


def from_star(star: Star, groups: Sequence[str], where: Conditions | None = None, keys: Mapping[str, str] | None = None) -> DataFrame:
    """The metric block by columns of the fact and of dimensions; the fact's own columns win.

    The fact is reduced to one row for each of its columns and keys that are asked for before it
    meets the dimensions, and conditions on its own columns are applied where it is read. Facts
    without a row in a dimension that is asked for drop out. ``keys`` names the columns that refer to
    dimensions, where they are not the dimensions' ids.
    """
    keys = {name: f"{name}_id" for name in DIMENSIONS} | dict(keys or {})
    needed = list(dict.fromkeys([*groups, *(where or {})]))
    own = [c for c in needed if c in star.fact.columns]
    of: dict[str, list[str]] = {}
    for c in needed:
        if c not in own:
            homes = [name for name in DIMENSIONS if star.dim(name) is not None and c in star.dim(name).columns]
            if not homes:
                raise ValueError(f"no such column: {c}")
            of.setdefault(homes[0], []).append(c)
    fact = _filtered(star.fact, {c: f for c, f in (where or {}).items() if c in own})
    by = list(dict.fromkeys([*own, *(keys[name] for name in of)]))
    out = fact.groupBy(*by).agg(*additive_measures(F.col("is_fraud"), F.col("amt")))
    for name, columns in of.items():
        out = out.join(star.dim(name).select(keys[name], *[c for c in columns if c != keys[name]]), keys[name])
    out = _filtered(out, {c: f for c, f in (where or {}).items() if c not in own})
    return with_ratios(out.groupBy(*groups).agg(*rolled_up()), tuple(groups))
