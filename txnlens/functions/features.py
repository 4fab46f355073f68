"""Per-row transaction features: calendar parts, age, great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
WEEKEND = (1, 7)  # numbers of dayofweek()


def calendar_columns(day: Column) -> dict[str, Column]:
    """Date parts that depend on the day alone (shared by the fact and the date dimension)."""
    number = F.dayofweek(day)
    name = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), number)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.day(day),
        # element_at() does not turn a null position into null.
        "day_of_week": F.when(number.isNotNull(), name),
        "is_weekend": F.coalesce(number.isin(*WEEKEND), F.lit(False)),
        "year_month": F.date_format(day, "yyyy-MM"),
    }


def with_calendar(df: DataFrame, ts: str = "trans_ts") -> DataFrame:
    """Add ``trans_date, year, month, day, day_of_week, is_weekend, year_month, hour``.

    A null timestamp gives null parts and ``is_weekend = false``.
    """
    day = F.to_date(ts)
    return df.withColumns({"trans_date": day, **calendar_columns(day), "hour": F.hour(ts)})


def age_years(ts: Column, dob: Column) -> Column:
    """Whole days between birth and transaction, in years of 365.25 days."""
    return F.datediff(F.to_date(ts), dob) / F.lit(365.25)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dphi = (phi2 - phi1) / 2
    half_dlambda = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_dphi), F.lit(2.0)) + F.cos(phi1) * F.cos(phi2) * F.pow(
        F.sin(half_dlambda), F.lit(2.0)
    )
    # Rounding can push the chord a hair over 1 at the antipodes.
    chord = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def with_features(df: DataFrame) -> DataFrame:
    """All features of a typed transaction frame."""
    return with_calendar(df).withColumns(
        {
            "age_at_txn_years": age_years(F.col("trans_ts"), F.col("dob")),
            "cust_merch_distance_km": haversine_km(
                F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")
            ),
        }
    )
