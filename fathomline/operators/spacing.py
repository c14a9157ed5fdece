"""Median distance to the nearest other point, by a grid of cells and growing neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.checkpoints import settled
from fathomline.errors import ProcessingError


def nearest_distances(points: DataFrame, cell: float | None = None) -> DataFrame:
    """pid, distance of every point of `points` (pid, x_m, y_m).

    Points are joined with those of the 3 x 3 cells around theirs. A distance up to the cell's side is final; the other
    points try again with cells four times as large, so every round deals with fewer points.
    """
    extent = points.agg(F.count("*").alias("n"), F.min("x_m").alias("w"), F.max("x_m").alias("e"), F.min("y_m").alias("s"), F.max("y_m").alias("t")).first()
    if extent.n < 2:
        raise ProcessingError("At least two points are needed to measure spacing.")
    span = max(extent.e - extent.w, extent.t - extent.s)
    if span <= 0:
        raise ProcessingError("All points are in one place.")
    cell = cell or max(math.sqrt(max(extent.e - extent.w, span / extent.n) * max(extent.t - extent.s, span / extent.n) / extent.n), span * 1e-9)
    open_, done = points.select("pid", "x_m", "y_m"), None
    while True:
        gx, gy = F.floor((F.col("x_m") - extent.w) / cell), F.floor((F.col("y_m") - extent.s) / cell)
        near = F.array(*(F.lit(v) for v in (-1, 0, 1)))
        left = open_.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("pid", "x_m", "y_m", (gx + F.col("dx")).alias("gx"), (gy + F.col("dy")).alias("gy"))
        right = points.select(F.col("pid").alias("q"), F.col("x_m").alias("qx"), F.col("y_m").alias("qy"), gx.alias("gx"), gy.alias("gy"))
        d = F.sqrt(F.pow(F.col("x_m") - F.col("qx"), 2) + F.pow(F.col("y_m") - F.col("qy"), 2))
        found = left.join(right, ["gx", "gy"]).where("pid != q").groupBy("pid").agg(F.min(d).alias("distance")).where(F.col("distance") <= (cell if cell <= span else float("inf")))
        found = settled(found)
        done = found if done is None else done.unionByName(found)
        if cell > span or found.count() == open_.count():
            return done
        open_ = open_.join(found.select("pid"), "pid", "left_anti")
        if not open_.take(1):
            return done
        cell *= 4


def median_spacing(points: DataFrame) -> float:
    value = nearest_distances(points).agg(F.median("distance")).first()[0]
    if value is None or not math.isfinite(value) or value <= 0:
        raise ProcessingError("The median spacing of the points is not a positive number.")
    return value
