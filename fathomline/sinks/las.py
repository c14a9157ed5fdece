"""LAS 1.2, point format 3, with the depth as an extra dimension."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.surface import las_scale_and_offset
from fathomline.sinks.text import replace_file

HEADER_SIZE, RECORD = 227, struct.Struct("<iiiHBBbBHdHHHf")


def las_records(points: DataFrame) -> tuple[DataFrame, dict]:
    """X, Y, Z, intensity and depth of each point, and the header's figures."""
    r = points.agg(F.count("*").alias("n"), *(f(F.col(c)).alias(f"{k}_{c}") for c in ("x_m", "y_m", "depth_m") for k, f in (("lo", F.min), ("hi", F.max)))).first().asDict()
    bounds = {"x": (r["lo_x_m"], r["hi_x_m"]), "y": (r["lo_y_m"], r["hi_y_m"]), "z": (-r["hi_depth_m"], -r["lo_depth_m"])}
    fit = {a: las_scale_and_offset(*b) for a, b in bounds.items()}
    whole = lambda c, a: F.rint((c - fit[a][1]) / fit[a][0]).cast("int")
    intensity = F.greatest(F.lit(0.0), F.least(F.col("beam_distance_m") * 1000, F.lit(65535.0))).cast("int")
    rows = points.select(whole(F.col("x_m"), "x").alias("x"), whole(F.col("y_m"), "y").alias("y"), whole(-F.col("depth_m"), "z").alias("z"), intensity.alias("intensity"), F.col("depth_m").cast("float").alias("depth"))
    return rows, {"n": r["n"], "bounds": bounds, "scales": [fit[a][0] for a in "xyz"], "offsets": [fit[a][1] for a in "xyz"]}


def _vlr(user: bytes, record: int, about: bytes, body: bytes) -> bytes:
    return struct.pack("<H16sHH32s", 0, user, record, len(body), about) + body


def extra_bytes_vlr(name: bytes) -> bytes:
    body = struct.pack("<2sBB32s4s24s24s24s24s24s32s", b"", 9, 0, name, b"", b"", b"", b"", b"", b"", b"depth, positive down")
    return _vlr(b"LASF_Spec", 4, b"Extra bytes", body)


def projection_vlr(code: int) -> bytes:
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, code)
    return _vlr(b"LASF_Projection", 34735, b"GeoKeyDirectoryTag", keys)


def write_las(points: DataFrame, path: Path, code: int) -> dict:
    rows, about = las_records(points)
    vlrs = extra_bytes_vlr(b"depth_m") + projection_vlr(code)
    (x0, x1), (y0, y1), (z0, z1) = about["bounds"].values()
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"fathomline", b"fathomline", 1, 1, HEADER_SIZE, HEADER_SIZE + len(vlrs), 2, 3, RECORD.size, about["n"], about["n"], 0, 0, 0, 0, *about["scales"], *about["offsets"], x1, x0, y1, y0, z1, z0)

    def chunks():
        yield head + vlrs
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield RECORD.pack(r.x, r.y, r.z, r.intensity, 0b00001001, 0, 0, 0, 0, 0.0, 0, 0, 0, r.depth)

    replace_file(path, chunks())
    return about
