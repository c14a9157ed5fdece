import json
import math
import random
import struct
import zipfile

import pytest

from fathomline.config import ProcessingConfig
from fathomline.errors import ProcessingError
from fathomline.functions.crc import crc16
from fathomline.operators import quality as q
from fathomline.operators.delaunay import triangulate
from fathomline.plans.survey import run_pipeline
from fathomline.queries import frame
from fathomline.sinks.text import xyz_line
from fathomline.sources import mavlink
from fathomline.sources.delimited import inspect_csv, read_delimited, select_column, sniff

CONFIG = ProcessingConfig("", "", "lat", "lon", "beam")


def flags(spark, rows):
    df = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "source_row long, lat string, lon string, beam string")
    return q.mark_duplicates(q.flag_quality(df, CONFIG)).orderBy("source_row").collect()


def test_row_flags(spark):
    at = ("55.93", "37.38")
    cases = [
        ((*at, " 2,5 "), ("valid", "")),
        (("91", "37.38", "2.5"), ("rejected", q.BAD_COORDINATES)),
        (("91", "37.38", ""), ("rejected", q.BAD_DEPTH)),
        *(((*at, b), ("rejected", q.BAD_DEPTH)) for b in ("abc", "1_000", "1d", "1,234.5", "-1", "150", None)),
        ((*at, "-0.05"), ("rejected", q.BAD_BEAM)),
        ((*at, "0"), ("rejected", q.BAD_BEAM)),
        ((*at, "3.5"), ("suspect", q.DUPLICATE)),
        (("90", "37.38", "2"), ("rejected", q.BAD_PROJECTION)),
    ]
    got = flags(spark, [c for c, _ in cases])
    assert [(r.quality_status, r.quality_reason) for r in got] == [w for _, w in cases]
    assert got[0].depth_m == pytest.approx(2.65)


def test_projection(spark):
    r = flags(spark, [("55.9345784", "37.3812133", "2")])[0]
    assert (r.x_m, r.y_m) == (pytest.approx(398874.33433, abs=1e-4), pytest.approx(6199981.92450, abs=1e-4))


@pytest.mark.parametrize("points", [[(random.Random(k).random(), random.Random(k + 999).random()) for k in range(60)], [(a, b) for a in range(7) for b in range(6)]])
def test_delaunay(points):
    x, y = [p[0] for p in points], [p[1] for p in points]
    faces = triangulate(x, y)
    cross = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    for a, b, c in faces:
        assert cross(a, b, c) > 0
        for d in set(range(len(x))) - {a, b, c}:
            m = [(x[v] - x[d], y[v] - y[d]) for v in (a, b, c)]
            z = [u * u + v * v for u, v in m]
            det = z[0] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]) - z[1] * (m[0][0] * m[2][1] - m[0][1] * m[2][0]) + z[2] * (m[0][0] * m[1][1] - m[0][1] * m[1][0])
            assert det <= 1e-12
    if isinstance(x[0], int):
        assert sum(cross(*f) for f in faces) == 2 * 6 * 5 and len(faces) == 60


def test_delaunay_refuses_lines():
    with pytest.raises(ProcessingError):
        triangulate([0, 1, 2, 3], [0, 1, 2, 3])


def test_crc():
    assert crc16(b"123456789") == 0x6F91


def test_crc_column(spark):
    from pyspark.sql import functions as F

    from fathomline.functions.crc import crc16_column

    data = [b"", b"123456789", bytes(range(256)), None]
    rows = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "i int, d binary").select("i", crc16_column(F.col("d")).alias("crc")).orderBy("i").collect()
    assert [r.crc for r in rows] == [None if d is None else crc16(d) for d in data]


def test_stream(spark, tmp_path):
    from fathomline.streaming.ingest import quality_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("lat,lon,beam\n55.93,37.38,2.5\n91,37.38,2.5\n")
    stream = quality_stream(spark, str(tmp_path / "in"), ["lat", "lon", "beam"], CONFIG)
    run = stream.writeStream.format("memory").queryName("flagged").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.quality_status, r.lat) for r in spark.table("flagged").collect()) == [("rejected", "91"), ("valid", "55.93")]


def test_projection_is_computed_once(spark):
    df = spark.createDataFrame([(2, "55.9", "37.3", "2")], "source_row long, lat string, lon string, beam string")
    plan = q.accepted_points(q.flag_quality(df, CONFIG))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("ATAN2(") == 1


def test_frames():
    good = frame(2, struct.pack("<QI", 1790845947987000, 310767))
    bad = good[:-1] + bytes([good[-1] ^ 0xFF])
    found = list(mavlink.frames(b"\xbbU\x00\x01" + bad + b"\xfe\x00" + good + good[:-1]))
    assert [(m, p is None) for _, m, p in found] == [(2, True), (2, False)]
    gps = struct.pack("<QiiiHHHHBB", 5000000, 559345784, 373812133, 183645, 100, 100, 0, 0, 6, 30)
    assert list(mavlink.frames(frame(24, gps, True)))[0][2] == gps.ljust(52, b"\0")


def test_logs(spark, tmp_path):
    (tmp_path / "a.klf").write_bytes(frame(2, struct.pack("<QI", 1790845947987000, 310767)) + frame(24, struct.pack("<QiiiHHHHBB", 320767000, 559345784, -5, 183645, 1, 1, 0, 0, 6, 30)))
    (tmp_path / "b.klf").write_bytes(frame(2, struct.pack("<QI", (1 << 63) + 7, 1)))
    frames = mavlink.read_frames(spark, str(tmp_path))
    gps = mavlink.gps_with_utc(frames).collect()
    assert [(g.alt_m, g.fix_type, g.lon_deg) for g in gps] == [(183.645, 6, -5e-7)] and gps[0].utc_s == pytest.approx(1790845957.987)
    times = {r.path[-5]: r for r in mavlink.system_times(frames).collect()}
    assert int(times["b"].time_unix_usec) == (1 << 63) + 7 and not times["b"].is_valid
    assert {r.path[-5]: r.boot_epoch_s for r in mavlink.boot_epochs(frames).collect()} == {"a": pytest.approx(1790845637.220), "b": None}


def test_sniff():
    assert sniff("широта;долгота;глубина\n1,5;2,5;3\n".encode("cp1251")) == ("cp1251", ";")
    assert sniff("a,b\n1,2\n".encode())[1] == ","
    assert sniff("é".encode()[:1] + b"")[0] == "utf-8-sig"
    assert sniff(b"one\ntwo\n")[1] == ","


def test_delimited(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text(" Latitude , Lon;x,depth\n1,2,3\n\n   \n4,NA\n")
    rows = read_delimited(spark, str(f)).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3", 2), ("4", None, None, 3)]
    assert inspect_csv(spark, str(f)).row_count == 4
    assert select_column([" Latitude ", "z"], "latitude") == " Latitude " and select_column(["z"], "latitude") is None
    f.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(ProcessingError):
        read_delimited(spark, str(f))
    with pytest.raises(ProcessingError):
        read_delimited(spark, str(f), ["c"])


def test_xyz():
    assert xyz_line(2.00005, 6199981.92445, 1) == "2.0000 6199981.9244 1.0000"


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    rows = [f"{55.93 + r.random() * 2e-4:.8f};{37.38 + r.random() * 3e-4:.8f};{2 + r.random():.2f}".replace(".", ",") for _ in range(60)]
    (tmp_path / "in.csv").write_text("\n".join(["Latitude;Longitude;Beam distance", *rows, "91;1;1"]))
    out = tmp_path / "job"
    report = run_pipeline(spark, ProcessingConfig(tmp_path / "in.csv", out, "Latitude", "Longitude", "Beam distance", pixel_size_m=0.5, max_triangle_edge_m=20.0))
    names = {"source.csv", "quality_points.csv", "accepted_points.csv", "bottom_points.xyz", "bottom_points.las", "depth_surface.obj", "depth_surface.stl", "depth_surface_metadata.json", "bathymetry_depth.tiff", "bathymetry_map.pdf", "processing_report.json", "processing_config.json"}
    assert {p.name for p in out.iterdir()} == names == set(zipfile.ZipFile(report["archive"]).namelist()) - {"./"}
    assert report["source_rows"] == 61 and report["rejected_rows"] == 1 and report["accepted_aggregated_points"] >= 50
    assert report["median_spacing_m"] > 0 and json.loads((out / "processing_report.json").read_text())["max_triangle_edge_mode"] == "manual"
    las = (out / "bottom_points.las").read_bytes()
    assert las[:4] == b"LASF" and struct.unpack_from("<I", las, 107)[0] == report["accepted_aggregated_points"]
    assert struct.unpack_from("<H", las, 105)[0] == 38 and len(las) == struct.unpack_from("<I", las, 96)[0] + 38 * report["accepted_aggregated_points"]
    tiff = (out / "bathymetry_depth.tiff").read_bytes()
    assert tiff[:2] == b"II" and b"-9999" in tiff
    assert (out / "bathymetry_map.pdf").read_bytes()[:5] == b"%PDF-"


def test_config():
    for bad in ({"min_depth_m": math.nan}, {"pixel_size_m": 0}, {"water_surface_to_transducer_m": -1}, {"min_depth_m": 5, "max_depth_m": 5}):
        with pytest.raises(ProcessingError):
            ProcessingConfig("", "", "a", "b", "c", **bad).validated()
