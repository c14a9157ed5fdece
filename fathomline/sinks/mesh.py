"""OBJ and binary STL of the kept surface, and the JSON that places them."""

from __future__ import annotations

import json
import struct
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.surface import mesh
from fathomline.sinks.text import replace_file


def write_mesh(points: DataFrame, faces: DataFrame, folder: Path, crs: str) -> None:
    vertices, triangles = mesh(points, faces)
    vertices, triangles = vertices.orderBy("vid").persist(), triangles.orderBy("fid").persist()

    def obj():
        for v in vertices.toLocalIterator():
            yield f"v {v.x:.8f} {v.y:.8f} {v.z:.8f}\n".encode()
        for t in triangles.toLocalIterator():
            yield f"f {t.i + 1} {t.j + 1} {t.k + 1}\n".encode()

    placed = triangles
    for c in "ijk":
        placed = placed.join(vertices.select(F.col("vid").alias(c), F.array("x", "y", "z").alias(f"{c}v")), c)

    def stl():
        yield b"\0" * 80 + struct.pack("<I", triangles.count())
        for t in placed.orderBy("fid").toLocalIterator():
            a, b, c = t.iv, t.jv, t.kv
            u, w = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
            normal = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
            size = sum(v * v for v in normal) ** 0.5 or 1.0
            yield struct.pack("<12fH", *(v / size for v in normal), *a, *b, *c, 0)

    replace_file(folder / "depth_surface.obj", obj())
    replace_file(folder / "depth_surface.stl", stl())
    r = points.agg(F.min("x_m").alias("x"), F.min("y_m").alias("y")).first()
    about = {"horizontal_crs": crs, "units": "metre", "local_origin_x_m": r.x, "local_origin_y_m": r.y, "model_z_definition": "z = -depth_m", "depth_definition": "depth_m is positive down"}
    write_json(folder / "depth_surface_metadata.json", about)


def write_json(path: Path, value: dict) -> None:
    replace_file(path, [json.dumps(value, ensure_ascii=False, indent=2).encode()])
