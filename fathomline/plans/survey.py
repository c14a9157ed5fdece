"""One survey from a delimited file to all its products."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.config import ProcessingConfig
from fathomline.functions.crs import check_crs
from fathomline.operators import quality as q
from fathomline.operators import surface as s
from fathomline.operators.spacing import median_spacing
from fathomline.sinks.geotiff import NODATA, raster_rows, write_geotiff
from fathomline.sinks.las import write_las
from fathomline.sinks.mesh import write_json, write_mesh
from fathomline.sinks.pdf import write_pdf
from fathomline.sinks.text import write_csv, write_xyz
from fathomline.sources.delimited import read_delimited

HASH_BLOCK = 1 << 20


def sha256sum(path: Path) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(HASH_BLOCK):
            digest.update(block)
    return digest.hexdigest()


def prepare(spark: SparkSession, config: ProcessingConfig) -> DataFrame:
    """The quality table of the configured file."""
    table = read_delimited(spark, str(config.input_csv), [config.latitude_field, config.longitude_field, config.beam_distance_field])
    return q.mark_duplicates(q.flag_quality(table, config))


def report_counts(quality: DataFrame) -> dict:
    r = quality.agg(F.count("*").alias("source_rows"), F.count_if(F.col("quality_status") == q.REJECTED).alias("rejected_rows"), F.count_if(F.col("quality_status") == q.SUSPECT).alias("suspect_rows"), F.count_if(~F.col("quality_reason").isin(q.BAD_DEPTH, q.BAD_BEAM, q.BAD_COORDINATES)).alias("flagged_good"))
    return r.first().asDict()


def run_pipeline(spark: SparkSession, config: ProcessingConfig, progress: Callable[[str], None] = lambda _: None) -> dict:
    """Writes every product to the output folder and a ZIP of it beside; returns the report and the archive's path."""
    config.validated()
    code = check_crs(config.input_crs, config.output_crs)
    out = Path(config.output_dir)
    out.mkdir(parents=True, exist_ok=True)
    progress("Reading and checking the soundings")
    quality = prepare(spark, config).persist()
    counts = report_counts(quality)
    q.need_points(counts.pop("flagged_good"), "valid soundings")
    q.need_points(counts["source_rows"] - counts["rejected_rows"], "projected soundings")
    points = s.with_ids(q.accepted_points(quality)).persist()
    n = points.count()
    q.need_points(n, "different positions")
    shutil.copy2(config.input_csv, out / "source.csv")
    write_csv(quality.orderBy("source_row"), out / "quality_points.csv")
    ordered = points.orderBy("pid")
    write_csv(ordered.drop("pid"), out / "accepted_points.csv")
    progress("Measuring spacing and triangulating")
    spacing = median_spacing(points)
    faces = s.with_max_edge(s.face_corners(s.tin_faces(points), points)).persist()
    before = faces.count()
    automatic = config.max_triangle_edge_m is None
    edge = s.automatic_edge(faces, spacing) if automatic else config.max_triangle_edge_m
    kept = s.filter_faces(faces, edge).persist()
    pixel = config.pixel_size_m or s.automatic_pixel(spacing)
    progress("Writing points")
    write_xyz(ordered, out / "bottom_points.xyz")
    las = write_las(ordered, out / "bottom_points.las", code)
    progress("Writing the surface")
    write_mesh(points, kept, out, config.output_crs)
    progress("Writing the raster and the map")
    grid = s.grid_of(points, pixel)
    cells = s.raster(kept, grid).persist()
    write_geotiff(cells, grid, out / "bathymetry_depth.tiff", code)
    depth = np.array(list(raster_rows(cells, grid)), np.float64)
    write_pdf(np.where(depth == NODATA, np.nan, depth), [(r.x_m, r.y_m) for r in points.select("x_m", "y_m").toLocalIterator()], grid, out / "bathymetry_map.pdf", config.output_crs)
    progress("Writing the report")
    depths = points.agg(F.min("depth_m").alias("lo"), F.max("depth_m").alias("hi")).first()
    report = {
        "source_file": Path(config.input_csv).name, "source_sha256": sha256sum(config.input_csv), "source_rows": counts["source_rows"], "accepted_aggregated_points": n,
        "rejected_rows": counts["rejected_rows"], "suspect_rows": counts["suspect_rows"], "gnss_transducer_offset_applied_in_source": config.source_gnss_transducer_offset_applied,
        "gnss_transducer_offset_applied_by_pipeline": False, "water_surface_to_transducer_m": config.water_surface_to_transducer_m, "formula": "depth_m = beam_distance_m + water_surface_to_transducer_m",
        "input_crs": config.input_crs, "output_crs": config.output_crs, "median_spacing_m": spacing, "pixel_size_m": pixel, "max_triangle_edge_m": edge, "max_triangle_edge_mode": "automatic" if automatic else "manual",
        "triangles_before_filter": before, "triangles_after_filter": kept.where("kept").count(), "minimum_depth_m": depths.lo, "maximum_depth_m": depths.hi, "las_scales": las["scales"], "las_offsets": las["offsets"], "las_z_definition": "z = -depth_m",
    }
    write_json(out / "processing_report.json", report)
    fields = ("latitude_field", "longitude_field", "beam_distance_field", "input_crs", "output_crs", "source_gnss_transducer_offset_applied", "water_surface_to_transducer_m", "pixel_size_m", "max_triangle_edge_m", "min_depth_m", "max_depth_m")
    write_json(out / "processing_config.json", {f: getattr(config, f) for f in fields})
    progress("Packing the results")
    archive = shutil.make_archive(str(out.parent / f"{out.name}_results"), "zip", out)
    for d in (quality, points, faces, kept, cells):
        d.unpersist()
    progress("Done")
    return {**report, "archive": archive}
