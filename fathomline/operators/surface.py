"""Triangulated surface, edge filter and raster."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.errors import ProcessingError
from fathomline.operators.delaunay import triangulate

MAX_CELLS = 20_000_000
AUTO_EDGE, FALLBACK_EDGE = 4.0, 1.001
LEAST_PIXEL = 0.05
EDGE_OF_TRIANGLE = -1e-12


def with_ids(points: DataFrame) -> DataFrame:
    """Dense pid from 0 in order of the cells."""
    from fathomline.sources.delimited import number_rows

    ordered = points.repartitionByRange("x_round", "y_round").sortWithinPartitions("x_round", "y_round")
    return number_rows(ordered, "pid", 0)


def tin_faces(points: DataFrame) -> DataFrame:
    """fid, i, j, k of the Delaunay triangles of `points` (pid, x_m, y_m).

    The triangulation of one survey is one task: it is not a relational operation. Its input is the aggregated
    points (a row for each occupied cell), and the raster limit bounds what surface they may span.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", ignore_index=True)
        pid = rows["pid"].tolist()
        faces = [tuple(pid[v] for v in t) for t in triangulate(rows["x_m"].tolist(), rows["y_m"].tolist())]
        return pd.DataFrame({"fid": range(len(faces)), **{c: [f[i] for f in faces] for i, c in enumerate("ijk")}}).astype("int64")

    return points.select("pid", "x_m", "y_m", F.lit(0).alias("survey")).groupBy("survey").applyInPandas(build, "fid long, i long, j long, k long")


def face_corners(faces: DataFrame, points: DataFrame) -> DataFrame:
    """Faces with the coordinates and depths of their corners."""
    out = faces
    for c, n in zip("ijk", "abc", strict=True):
        own = [F.col(v).alias(f"{n}{w}") for v, w in (("x_m", "x"), ("y_m", "y"), ("depth_m", "d")) if v in points.columns]
        out = out.join(points.select(F.col("pid").alias(c), *own), c)
    return out


def with_max_edge(corners: DataFrame) -> DataFrame:
    d = lambda p, q: F.sqrt(F.pow(F.col(f"{p}x") - F.col(f"{q}x"), 2) + F.pow(F.col(f"{p}y") - F.col(f"{q}y"), 2))
    return corners.withColumn("max_edge_m", F.greatest(d("a", "b"), d("b", "c"), d("c", "a")))


def filter_faces(faces: DataFrame, max_edge_m: float) -> DataFrame:
    """Marks as kept the faces whose longest edge is no longer than this; an error when none is."""
    if not math.isfinite(max_edge_m) or max_edge_m <= 0:
        raise ProcessingError("The longest edge must be a positive number.")
    marked = faces.withColumn("kept", F.col("max_edge_m") <= max_edge_m)
    r = marked.agg(F.count_if("kept").alias("n"), F.min("max_edge_m").alias("lo"), F.max("max_edge_m").alias("hi")).first()
    if not r.n:
        raise ProcessingError(f"No triangle is left: their longest edges are between {r.lo} and {r.hi} m.")
    return marked


def automatic_edge(faces: DataFrame, spacing: float) -> float:
    """Four times the spacing, or a little over the shortest longest edge when that keeps nothing."""
    least = faces.agg(F.min("max_edge_m")).first()[0]
    return AUTO_EDGE * spacing if least <= AUTO_EDGE * spacing else FALLBACK_EDGE * least


def automatic_pixel(spacing: float) -> float:
    return max(spacing / 2, LEAST_PIXEL)


def grid_of(points: DataFrame, pixel: float, most: int = MAX_CELLS) -> dict:
    r = points.agg(F.min("x_m").alias("west"), F.max("x_m").alias("east"), F.min("y_m").alias("south"), F.max("y_m").alias("north")).first().asDict()
    width, height = (max(1, math.ceil((hi - lo) / pixel)) for hi, lo in ((r["east"], r["west"]), (r["north"], r["south"])))
    if width * height > most:
        raise ProcessingError(f"The raster would have {width * height} cells; {most} are allowed. Choose a larger pixel.")
    return {**r, "width": width, "height": height, "pixel": pixel}


def raster(corners: DataFrame, grid: dict) -> DataFrame:
    """row, col, depth of the cells whose centre lies in a kept triangle, linearly interpolated; other cells are absent.

    Each triangle meets the cells of its bounding box only. Of several triangles around a centre (a common edge)
    the least fid counts, kept or not.
    """
    w, n, px = grid["west"], grid["north"], grid["pixel"]
    lo = lambda v, top: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), F.lit(top - 1)))
    least = lambda c: F.least(*(F.col(f"{p}{c}") for p in "abc"))
    most = lambda c: F.greatest(*(F.col(f"{p}{c}") for p in "abc"))
    boxed = corners.withColumn("row", F.explode(F.sequence(lo((n - most("y")) / px, grid["height"]), lo((n - least("y")) / px, grid["height"])))).withColumn("col", F.explode(F.sequence(lo((least("x") - w) / px, grid["width"]), lo((most("x") - w) / px, grid["width"]))))
    placed = boxed.withColumns({"px": w + (F.col("col") + 0.5) * px, "py": n - (F.col("row") + 0.5) * px})
    det = F.expr("(by - cy) * (ax - cx) + (cx - bx) * (ay - cy)")
    first = placed.withColumns({"l1": F.expr("((by - cy) * (px - cx) + (cx - bx) * (py - cy))") / det, "l2": F.expr("((cy - ay) * (px - cx) + (ax - cx) * (py - cy))") / det}).withColumn("l3", F.expr("1 - l1 - l2"))
    inside = first.where(F.least("l1", "l2", "l3") >= EDGE_OF_TRIANGLE)
    one = inside.groupBy("row", "col").agg(F.min_by(F.struct("kept", F.expr("l1 * ad + l2 * bd + l3 * cd").alias("depth")), "fid").alias("v"))
    return one.where("v.kept").select("row", "col", "v.depth")


def mesh(points: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: vid, x, y, z; faces: fid, i, j, k in vid). Origin: least x and y of all points; only used vertices stay."""
    from fathomline.sources.delimited import number_rows

    r = points.agg(F.min("x_m").alias("x"), F.min("y_m").alias("y")).first()
    kept = faces.where("kept")
    used = kept.select(F.explode(F.array("i", "j", "k")).alias("pid")).distinct()
    some = points.join(used, "pid", "left_semi").repartitionByRange("pid").sortWithinPartitions("pid")
    vertices = number_rows(some.select("pid", (F.col("x_m") - r.x).alias("x"), (F.col("y_m") - r.y).alias("y"), (-F.col("depth_m")).alias("z")), "vid", 0)
    out = kept.select("fid", "i", "j", "k")
    for c in "ijk":
        out = out.join(vertices.select(F.col("pid").alias(c), F.col("vid").alias(f"v{c}")), c).drop(c).withColumnRenamed(f"v{c}", c)
    return vertices.select("vid", "x", "y", "z"), out.select("fid", "i", "j", "k")


def las_scale_and_offset(low: float, high: float) -> tuple[float, float]:
    """Millimetres, or coarser where the span would not fit 32 bits."""
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ProcessingError("There are no finite values to write.")
    room, span = 0.9 * (2**31 - 1), high - low
    return (0.001 if span <= room * 0.001 else span / room), low
