"""Row flags: parse, derive the depth, judge, project. All are projections; no row is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.config import ProcessingConfig
from fathomline.errors import ProcessingError
from fathomline.functions.crs import check_crs, project
from fathomline.functions.numeric import normalize_numeric

# fixed values: statuses, and reasons as they appear in the quality table
VALID, REJECTED, SUSPECT = "valid", "rejected", "suspect"
BAD_COORDINATES = "Некорректные координаты"
BAD_BEAM = "Некорректный Beam distance"
BAD_DEPTH = "Глубина вне допустимого диапазона"
BAD_PROJECTION = "Ошибка преобразования координат"
DUPLICATE = "Повторная плановая точка, включена в медианную агрегацию"
LEAST_POINTS = 3


def flag_quality(table: DataFrame, config: ProcessingConfig) -> DataFrame:
    """Source columns, source_row and the derived columns up to quality_reason. A source column named like a derived one is replaced after parsing."""
    code = check_crs(config.input_crs, config.output_crs)
    parsed = table.select("*", *(normalize_numeric(F.col(f"`{f}`")).alias(n) for f, n in ((config.latitude_field, "_lat"), (config.longitude_field, "_lon"), (config.beam_distance_field, "_beam"))))
    depth = F.col("_beam") + config.water_surface_to_transducer_m
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))
    bad_coordinates = F.col("_lat").isNull() | F.col("_lon").isNull() | ~F.col("_lat").between(-90, 90) | ~F.col("_lon").between(-180, 180)
    bad_beam = ~finite(F.col("_beam")) | (F.col("_beam") <= 0)
    bad_depth = ~finite(depth) | (depth < config.min_depth_m) | (depth > config.max_depth_m)
    reason = F.when(bad_depth, BAD_DEPTH).when(bad_beam, BAD_BEAM).when(bad_coordinates, BAD_COORDINATES).otherwise("")
    flagged = project(parsed.withColumn("_reason", reason), "_lon", "_lat", "_x", "_y", code, F.col("_reason") == "")
    reason = F.when((F.col("_reason") == "") & (F.col("_x").isNull() | F.col("_y").isNull()), BAD_PROJECTION).otherwise(F.col("_reason"))
    placed = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    out = flagged.withColumns({"_reason": reason, "_x": F.when(placed, F.col("_x")), "_y": F.when(placed, F.col("_y"))})
    derived = {"source_row": F.col("source_row"), "latitude_deg": F.col("_lat"), "longitude_deg": F.col("_lon"), "beam_distance_m": F.col("_beam"), "depth_m": F.col("_beam") + config.water_surface_to_transducer_m, "x_m": F.col("_x"), "y_m": F.col("_y"), "quality_status": F.when(F.col("_reason") == "", VALID).otherwise(REJECTED), "quality_reason": F.col("_reason")}
    return out.withColumns(derived).drop("_lat", "_lon", "_beam", "_reason", "_x", "_y")


def with_keys(quality: DataFrame) -> DataFrame:
    """The 1 cm cell of each placed row: scaled, rounded half to even, scaled back."""
    return quality.withColumns({"x_round": F.rint(F.col("x_m") * 100) / 100, "y_round": F.rint(F.col("y_m") * 100) / 100})


def mark_duplicates(quality: DataFrame) -> DataFrame:
    """Second and later rows of a cell become suspect; they still count in its median.

    A cell's first row is found by a partial aggregate and a join, which Spark can split where one cell is hot; a window could not be.
    """
    keyed = with_keys(quality)
    first = keyed.where(F.col("quality_status") == VALID).groupBy("x_round", "y_round").agg(F.min("source_row").alias("_first"))
    joined = keyed.join(first, ["x_round", "y_round"], "left")
    again = (F.col("quality_status") == VALID) & (F.col("source_row") > F.col("_first"))
    return joined.withColumns({"quality_reason": F.when(again, DUPLICATE).otherwise(F.col("quality_reason")), "quality_status": F.when(again, SUSPECT).otherwise(F.col("quality_status"))}).select(*quality.columns)


def accepted_points(quality: DataFrame) -> DataFrame:
    """Medians and count of each cell, over valid and suspect rows, sorted by the cell."""
    rows = with_keys(quality).where(F.col("quality_status") != REJECTED)
    columns = ("x_m", "y_m", "depth_m", "beam_distance_m")
    return rows.groupBy("x_round", "y_round").agg(*(F.median(c).alias(c) for c in columns), F.count("*").alias("sample_count")).orderBy("x_round", "y_round")


def need_points(n: int, what: str) -> None:
    if n < LEAST_POINTS:
        raise ProcessingError(f"At least {LEAST_POINTS} {what} are needed; there are {n}.")


def quality_counts(quality: DataFrame) -> DataFrame:
    return quality.groupBy("quality_status", "quality_reason").agg(F.count("*").alias("rows"))
