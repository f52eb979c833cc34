"""Trips: staged text columns to a typed table, quality summaries, distinct places encoded once and joined."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.scalars import parsed_time, text_or_null, typed

NUMBERS = {"trip_seconds": "long", "trip_miles": "double", "pickup_community_area": "int", "dropoff_community_area": "int", "fare": "double", "tip": "double", "additional_charges": "double", "trip_total": "double", "trips_pooled": "int", "pickup_centroid_latitude": "double", "pickup_centroid_longitude": "double", "dropoff_centroid_latitude": "double", "dropoff_centroid_longitude": "double"}
FLAGS, PLACES = ("shared_trip_authorized", "shared_trip_match"), ("pickup_centroid_location", "dropoff_centroid_location")


def clean(staged: DataFrame, source: str, time_format: str = "MM/dd/yyyy hh:mm:ss a") -> DataFrame:
    """The typed table; columns that a year lacks are null, malformed values become null."""
    has = lambda c: F.col(c) if c in staged.columns else F.lit(None).cast("string")
    return staged.select(
        F.lit(source).alias("source_file"), text_or_null(has("trip_id")).alias("trip_id"), parsed_time(has("trip_start_timestamp"), time_format).alias("trip_start_timestamp"), parsed_time(has("trip_end_timestamp"), time_format).alias("trip_end_timestamp"),
        *[typed(has(c), kind).alias(c) for c, kind in NUMBERS.items()], *[typed(has(c), "boolean").cast("tinyint").alias(c) for c in FLAGS], *[text_or_null(has(c)).alias(c) for c in PLACES])


def quality(trips: DataFrame) -> DataFrame:
    """By source: rows, range of times, null and negative counts."""
    null = lambda c: F.count_if(F.col(c).isNull()).alias(f"{c}_null")
    less = lambda c: F.count_if(F.col(c) < 0).alias(f"{c}_negative")
    return trips.groupBy("source_file").agg(F.count("*").alias("rows"), F.min("trip_start_timestamp").alias("first"), F.max("trip_start_timestamp").alias("last"), *[null(c) for c in ("trip_id", "trip_start_timestamp", "fare", "tip", "pickup_centroid_location")], *[less(c) for c in ("trip_seconds", "trip_miles", "fare", "tip")])


def not_shared(authorized: Column, null_is_not: bool = True) -> Column:
    """Trips that were not shared; whether a null counts as not shared is the caller's choice."""
    return F.coalesce(authorized, F.lit(0)) == 0 if null_is_not else authorized == 0


def places(trips: DataFrame, encode: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """location, latitude, longitude, cell: each distinct place encoded once, however many trips start or end there."""
    one = lambda side: trips.select(F.col(f"{side}_centroid_location").alias("location"), F.col(f"{side}_centroid_latitude").alias("latitude"), F.col(f"{side}_centroid_longitude").alias("longitude"))
    distinct = one("pickup").union(one("dropoff")).filter("location is not null").groupBy("location").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))

    def run(frames):
        for f in frames:
            yield f.assign(cell=encode(f["latitude"], f["longitude"]))

    return distinct.mapInPandas(run, "location string, latitude double, longitude double, cell string")


def grid_cell(degrees: float = 0.002) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A plain latitude-longitude grid as the cell function; another (such as a hexagonal index) fits the same place."""

    def encode(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return (lat // degrees).astype("Int64").astype("string") + ":" + (lon // degrees).astype("Int64").astype("string")

    return encode


def ring(cell: Column, k: int = 1) -> Column:
    """The cells of a plain grid up to ``k`` steps from ``cell``, without it."""
    row, col = (F.split(cell, ":")[i].cast("long") for i in (0, 1))
    steps = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if (a, b) != (0, 0)]
    return F.array(*[F.concat_ws(":", (row + a).cast("string"), (col + b).cast("string")) for a, b in steps])


def cell_distance(a: Column, b: Column) -> Column:
    """Steps between two cells of a plain grid, diagonal ones being one."""
    part = lambda c, i: F.split(c, ":")[i].cast("long")
    return F.greatest(*[F.abs(part(a, i) - part(b, i)) for i in (0, 1)])


def with_cells(trips: DataFrame, cells: DataFrame) -> DataFrame:
    """Both ends' cells, by two left joins with the same small table."""
    p, d = (cells.select(F.col("location").alias(f"{s}_centroid_location"), F.col("cell").alias(f"{s}_cell")) for s in ("pickup", "dropoff"))
    return trips.join(p, "pickup_centroid_location", "left").join(d, "dropoff_centroid_location", "left")
