"""Numeric, price and distance expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reciprocal(price: str | Column) -> Column:
    """Implied probability of a decimal price; NULL for a missing or zero price."""
    return F.try_divide(F.lit(1.0), _col(price))


def fair_pair(home: str | Column, away: str | Column) -> tuple[Column, Column, Column]:
    """Normalised implied probabilities and the overround."""
    h, a = reciprocal(home), reciprocal(away)
    total = h + a
    return h / total, a / total, total


def clipped(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would skip it)."""
    c = _col(c)
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def flag(condition: Column) -> Column:
    """1.0 or 0.0, NULL where the condition is unknown."""
    return condition.cast("double")


def to_even(c: str | Column) -> Column:
    """Nearest even number, halves of two going to the even half."""
    return F.bround(_col(c) / 2) * 2


def haversine_km(lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column) -> Column:
    """Great-circle distance."""
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dlat, dlon = a2 - a1, F.radians(_col(lon2)) - F.radians(_col(lon1))
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2.0 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def known_share(*columns: str) -> Column:
    """Share of the columns that are not NULL in the row."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def season_week(date: str | Column, start: str | Column, last: int = 27) -> Column:
    """Round number from the weeks since the season start, within 1..last."""
    week = F.floor(F.datediff(_col(date), _col(start)) / 7) + 1
    return F.greatest(F.lit(1), F.least(F.lit(last), week)).cast("int")
