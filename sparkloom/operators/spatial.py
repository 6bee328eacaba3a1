"""Radius and nearest-neighbour searches around a literal point, in any number of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors


def within(coords: list[Column], center: list[float], radius: float) -> Column:
    """A box on each coordinate, which scans can use, and the exact closed ball."""
    box = F.lit(True)
    for c, x in zip(coords, center, strict=True):
        box = box & c.between(x - radius, x + radius)
    squares = sum(((c - F.lit(float(x))) * (c - F.lit(float(x))) for c, x in zip(coords, center, strict=True)), F.lit(0.0))
    return box & (F.sqrt(squares) <= radius)


def within_array(place: Column, center: list[float], radius: float, first_two: bool = False) -> Column:
    """The same on an array column. Rows of other dimensions are not within; with `first_two` only those two count."""
    dims = 2 if first_two else len(center)
    fits = F.size(place) >= 2 if first_two else F.size(place) == len(center)
    return F.coalesce(fits & within([F.get(place, i) for i in range(dims)], list(center[:dims]), radius), F.lit(False))


def range_search(df: DataFrame, coords: list[str], center: list[float], radius: float) -> DataFrame:
    """No rows where the point has other dimensions than the table."""
    return df.where(within([F.col(c) for c in coords], center, radius)) if len(coords) == len(center) else df.limit(0)


def nearest(df: DataFrame, coords: list[str], point: list[float], k: int, key: str) -> DataFrame:
    """The k nearest rows with their distance, ascending; ties by key."""
    squares = sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(coords, point, strict=True)), F.lit(0.0))
    return df.withColumn("dist", F.sqrt(squares)).orderBy(F.round("dist", vectors.EXACT), key).limit(k).withColumn("dist", F.round("dist", 6))


def nearest_array(df: DataFrame, place: str, point: list[float], k: int, key: str) -> DataFrame:
    """The same on an array column of any number of dimensions; rows of other dimensions are not found."""
    return df.withColumn("dist", vectors.distance(F.col(place), vectors.literal(point))).where("dist is not null").orderBy(F.round("dist", vectors.EXACT), key).limit(k)
