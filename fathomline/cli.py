"""python -m fathomline.cli INPUT OUTPUT [options]"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from fathomline.config import ProcessingConfig
from fathomline.plans.survey import run_pipeline
from fathomline.sources.delimited import inspect_csv, select_column


def number(low: float, high: float):
    def parse(text: str) -> float:
        v = float(text)
        if not low <= v <= high:
            raise argparse.ArgumentTypeError(f"must be from {low} to {high}")
        return v

    return parse


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input", type=Path)
    p.add_argument("output", type=Path)
    for name in ("latitude", "longitude", "beam-distance"):
        p.add_argument(f"--{name}")
    p.add_argument("--output-crs", default="EPSG:32637")
    p.add_argument("--offset", type=number(0, 10), default=0.15)
    p.add_argument("--pixel", type=number(0, 1000), default=0, help="0: automatic")
    p.add_argument("--max-edge", type=number(0, 10000), default=0, help="0: automatic")
    p.add_argument("--min-depth", type=number(0.001, 1000), default=0.05)
    p.add_argument("--max-depth", type=number(0.01, 10000), default=100.0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("fathomline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = inspect_csv(spark, str(a.input)).columns
    field = lambda given, kind: given or select_column(names, kind) or p.error(f"no column for {kind} in {names}")
    config = ProcessingConfig(a.input, a.output, field(a.latitude, "latitude"), field(a.longitude, "longitude"), field(a.beam_distance, "beam_distance"), output_crs=a.output_crs, water_surface_to_transducer_m=a.offset, pixel_size_m=a.pixel or None, max_triangle_edge_m=a.max_edge or None, min_depth_m=a.min_depth, max_depth_m=a.max_depth)
    return run_pipeline(spark, config, print)


if __name__ == "__main__":
    main()
