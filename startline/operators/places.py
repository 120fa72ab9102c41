"""Nearest places by a grid: cells of space, equi-joins on cells, cells that grow where places are few.

Places lie on the unit sphere, which is cut into cubes, so neither a pole nor the date line is an edge. All places
within a cell's side of a point are in its cell or the 26 around it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from startline.operators import store

EARTH_KM = 6371.0


def cells(lat: Column, lon: Column, side: float) -> list[Column]:
    """The cube of a point, one number for each axis."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.floor(x / side).cast("int") for x in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


def chord(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """The straight distance of two points of the unit sphere."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    return 2 * F.sqrt(half(other_lat - lat) + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * half(other_lon - lon))


def kilometres(straight: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.least(straight / 2, F.lit(1.0)))


def nearest(points: DataFrame, places: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """id, place, km, rank: the k nearest places of every point, of equal ones (to `digits` of km) the smaller place.

    From points (id, lat, lon) and places (place, lat, lon); rows without coordinates take no part, and a point has
    fewer than k if there are no more. Points of equal coordinates are asked for once, and of places of equal
    coordinates only the k smallest can be an answer. Cells hold about k of those at first; coordinates that are not
    sure of their k in their surroundings look again in cells of twice the side.
    """
    known = lambda df: df.where("lat IS NOT NULL AND lon IS NOT NULL")
    points = known(points).select("id", "lat", "lon")
    same = Window.partitionBy("lat", "lon").orderBy("place")
    places = known(places).select("place", "lat", "lon").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k)
    left, places = store.settle(points.select("lat", "lon").distinct()), store.settle(places.select("place", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    side, done = min(2.0, math.sqrt(4 * math.pi * k / max(1, places.count()))), []
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip((x, y, z), "xyz", strict=True)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    best = Window.partitionBy("lat", "lon").orderBy("km", "place")
    while True:
        there = places.select("place", "_lat", "_lon", *[c.alias(n) for c, n in zip(cells(F.col("_lat"), F.col("_lon"), side), "xyz", strict=True)])
        asked = left.withColumns(dict(zip(("_x", "_y", "_z"), cells(F.col("lat"), F.col("lon"), side), strict=True))).withColumn("d", around)
        asked = asked.select("lat", "lon", *[(F.col(f"_{n}") + F.col(f"d.{n}")).alias(n) for n in "xyz"])
        met = asked.join(there, ["x", "y", "z"]).withColumn("far", chord(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
        if side < 2:
            met = met.where(F.col("far") <= side)  # beyond it others may be nearer
        found = store.settle(met.withColumn("km", F.round(kilometres(F.col("far")), digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("lat", "lon", "place", "km", "rank"))
        if side >= 2:
            done.append(found)
            break
        sure = found.where(F.col("rank") == k).select("lat", "lon")
        done.append(found.join(sure, ["lat", "lon"], "left_semi"))
        left, side = store.settle(left.join(sure, ["lat", "lon"], "left_anti")), min(2.0, side * 2)
        if left.isEmpty():
            break
    answers = reduce(DataFrame.unionByName, done)
    return points.join(answers, ["lat", "lon"]).select("id", "place", "km", "rank")
