"""Places in hexagonal cells: suppliers stand in for pickup points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import hexagons as H
from sparkwright.plans.studies import supplier_places


def hexagon_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of every cell that has a place, with that of its first and second ring, and the cell's centre."""
    places = H.with_hexagons(supplier_places(spark, sf_dir), "latitude", "longitude", 8)
    cells = places.filter("cell is not null").groupBy("cell").agg(F.sum("activity").alias("activity"), F.count("*").alias("places"))
    first, second = H.smoothed(cells, "cell", "activity", 1), H.smoothed(cells, "cell", "activity", 2)
    joined = cells.join(first.select("cell", F.col("near").alias("ring_1"), F.col("near_cells").alias("cells_1")), "cell").join(second.select("cell", F.col("near").alias("disk_2"), F.col("near_cells").alias("cells_2")), "cell")
    at = H.centre_udf(F.col("cell"))
    return joined.select("cell", "places", "activity", "ring_1", "cells_1", (F.col("disk_2") - F.col("ring_1")).alias("ring_2"), (F.col("cells_2") - F.col("cells_1")).alias("cells_of_ring_2"), F.round(at["lat"], 6).alias("lat"), F.round(at["lon"], 6).alias("lon"))


#: No SQL knows these cells; tests hold the query against cells and steps counted one by one.
QUERIES = {"m_hexagon_activity": hexagon_activity}
