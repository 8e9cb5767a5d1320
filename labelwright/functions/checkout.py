"""Column expressions for order tables: calendar parts, lead time, lateness, distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def month_text(ts: Column) -> Column:
    return F.month(ts).cast("string")


def weekday_text(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("string")


def hour_bin(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when(h <= 5, "night").when(h <= 11, "morning").when(h <= 17, "afternoon").when(h <= 23, "evening")
    )


def lead_days(promised: Column, purchased: Column) -> Column:
    return F.datediff(F.to_date(promised), F.to_date(purchased))


def late(delivered: Column, promised: Column) -> Column:
    """1 when delivered on a later calendar day than promised."""
    return (F.to_date(delivered) > F.to_date(promised)).cast("int")


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance; null when any coordinate is null."""
    half_phi = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lam = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_phi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lam), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(chord))
