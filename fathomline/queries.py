"""Queries of the survey engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fathomline.config import ProcessingConfig
from fathomline.functions.crc import crc16, crc16_column
from fathomline.functions.crs import projection_query
from fathomline.functions.numeric import normalize_numeric
from fathomline.operators import quality as q
from fathomline.operators import surface as s
from fathomline.operators.spacing import median_spacing, nearest_distances
from fathomline.sinks.las import las_records
from fathomline.sinks.text import xyz_line
from fathomline.sources import mavlink

CONFIG = ProcessingConfig("", "", "lat_s", "lon_s", "beam_s")
ZONE = 32637
#: Soundings from `events`, the same text in both engines.
SOUNDINGS = """SELECT event_id + 2 AS source_row,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 101 = 0 THEN '95.0' ELSE CAST(55.93 + ((event_id * 37) % 400) * 0.000002 AS STRING) END AS lat_s,
  CAST(37.38 + ((event_id * 91) % 300) * 0.000003 AS STRING) AS lon_s,
  CASE WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN '1_000' WHEN event_id % 79 = 0 THEN '-0.05'
       WHEN event_id % 5 = 0 THEN concat('  ', replace(CAST(value AS STRING), '.', ','), ' ') ELSE CAST(value AS STRING) END AS beam_s
FROM events"""
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER = "CASE WHEN regexp_matches(replace(trim({0}), ',', '.'), '" + PLAIN + "') THEN try_cast(replace(trim({0}), ',', '.') AS DOUBLE) END"
_FLAGGED = f"""
soundings AS ({SOUNDINGS}),
parsed AS (SELECT source_row, {NUMBER.format("lat_s")} AS lat, {NUMBER.format("lon_s")} AS lon, {NUMBER.format("beam_s")} AS beam FROM soundings),
judged AS (SELECT *, beam + 0.15::DOUBLE AS depth,
  CASE WHEN beam IS NULL OR beam + 0.15::DOUBLE < 0.05 OR beam + 0.15::DOUBLE > 100 THEN '{q.BAD_DEPTH}' WHEN beam <= 0 THEN '{q.BAD_BEAM}'
       WHEN lat IS NULL OR lon IS NULL OR lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN '{q.BAD_COORDINATES}' ELSE '' END AS reason FROM parsed),
good AS ({projection_query("SELECT * FROM judged WHERE reason = ''", ZONE)}),
placed AS (SELECT j.*, g.x, g.y FROM judged j LEFT JOIN good g USING (source_row)),
keyed AS (SELECT *, round_even(x * 100, 0) / 100 AS xr, round_even(y * 100, 0) / 100 AS yr FROM placed)
"""


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soundings(spark, sf_dir):
    text = SOUNDINGS.replace("FROM events", "FROM {events}")
    return spark.sql(text, events=_table(spark, sf_dir, "events"))


def flagged(spark, sf_dir):
    return q.mark_duplicates(q.flag_quality(soundings(spark, sf_dir), CONFIG))


def qc_status(spark, sf_dir):
    return q.quality_counts(q.flag_quality(soundings(spark, sf_dir), CONFIG))


def numeric_parse(spark, sf_dir):
    rows = soundings(spark, sf_dir)
    return rows.select("source_row", *(normalize_numeric(F.col(c)).alias(n) for c, n in (("lat_s", "lat"), ("lon_s", "lon"), ("beam_s", "beam"))))


def project_utm(spark, sf_dir):
    rows = q.flag_quality(soundings(spark, sf_dir), CONFIG).where("x_m IS NOT NULL")
    return rows.select("source_row", F.round("x_m", 3).alias("x"), F.round("y_m", 3).alias("y"))


def duplicates(spark, sf_dir):
    return flagged(spark, sf_dir).select("source_row", "quality_status", "quality_reason")


def accepted_points(spark, sf_dir):
    rows = q.accepted_points(flagged(spark, sf_dir))
    return rows.select("x_round", "y_round", *(F.round(c, 6).alias(c) for c in ("depth_m", "beam_distance_m")), "sample_count")


def survey_report(spark, sf_dir):
    quality = flagged(spark, sf_dir)
    rows = quality.agg(F.count("*").alias("source_rows"), F.count_if(F.col("quality_status") == q.REJECTED).alias("rejected_rows"), F.count_if(F.col("quality_status") == q.SUSPECT).alias("suspect_rows"))
    points = q.accepted_points(quality).agg(F.count("*").alias("accepted_aggregated_points"), F.round(F.min("depth_m"), 6).alias("minimum_depth_m"), F.round(F.max("depth_m"), 6).alias("maximum_depth_m"))
    return rows.crossJoin(points)  # one row each


POINTS = """SELECT x_m AS x_round, y_m AS y_round, x_m, y_m, min(depth_m) AS depth_m, min(depth_m) AS beam_distance_m FROM (
  SELECT CAST((s_suppkey * 7919 + 13) % 4093 AS DOUBLE) AS x_m, CAST((s_suppkey * s_suppkey * 31 + s_suppkey * 977 + 7) % 4091 AS DOUBLE) AS y_m,
         CAST(1 + s_suppkey % 17 AS DOUBLE) AS depth_m FROM supplier) AS p GROUP BY x_m, y_m"""
_PIDS = f"raw AS ({POINTS}), pts AS (SELECT *, row_number() OVER (ORDER BY x_round, y_round) - 1 AS pid FROM raw)"
_TIN = f"""{_PIDS},
tri AS (SELECT a.pid AS p, b.pid AS q, c.pid AS r, a.x_m ax, a.y_m ay, b.x_m bx, b.y_m "by", c.x_m cx, c.y_m cy, a.depth_m ad, b.depth_m bd, c.depth_m cd,
    (b.x_m - a.x_m) * (c.y_m - a.y_m) - (b.y_m - a.y_m) * (c.x_m - a.x_m) AS o FROM pts a JOIN pts b ON a.pid < b.pid JOIN pts c ON b.pid < c.pid),
good AS (SELECT * FROM tri t WHERE o <> 0 AND NOT EXISTS (SELECT 1 FROM pts d WHERE d.pid NOT IN (t.p, t.q, t.r) AND sign(t.o) * (
    ((ax-d.x_m)*(ax-d.x_m)+(ay-d.y_m)*(ay-d.y_m)) * ((bx-d.x_m)*(cy-d.y_m)-("by"-d.y_m)*(cx-d.x_m))
  - ((bx-d.x_m)*(bx-d.x_m)+("by"-d.y_m)*("by"-d.y_m)) * ((ax-d.x_m)*(cy-d.y_m)-(ay-d.y_m)*(cx-d.x_m))
  + ((cx-d.x_m)*(cx-d.x_m)+(cy-d.y_m)*(cy-d.y_m)) * ((ax-d.x_m)*("by"-d.y_m)-(ay-d.y_m)*(bx-d.x_m))) > 0)),
edges AS (SELECT *, greatest(sqrt((ax-bx)*(ax-bx)+(ay-"by")*(ay-"by")), sqrt((bx-cx)*(bx-cx)+("by"-cy)*("by"-cy)), sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay))) AS e FROM good)"""
MANUAL_EDGE, PIXEL = 900.0, 25.0


def tin_points(spark, sf_dir):
    return s.with_ids(spark.sql(POINTS.replace("FROM supplier", "FROM {supplier}"), supplier=_table(spark, sf_dir, "supplier")))


def _corners(spark, sf_dir):
    points = tin_points(spark, sf_dir).persist()
    return points, s.with_max_edge(s.face_corners(s.tin_faces(points), points)).persist()


def _triple(faces, *more):
    t = F.array_sort(F.array("i", "j", "k"))
    return faces.select(t[0].alias("p"), t[1].alias("q"), t[2].alias("r"), *more)


def tin_faces(spark, sf_dir):
    return _triple(s.tin_faces(tin_points(spark, sf_dir)))


def face_edges(spark, sf_dir):
    return _triple(_corners(spark, sf_dir)[1], F.round("max_edge_m", 6).alias("max_edge_m"))


def face_filter_manual(spark, sf_dir):
    return _triple(s.filter_faces(_corners(spark, sf_dir)[1], MANUAL_EDGE).where("kept"))


def face_filter_auto(spark, sf_dir):
    points, faces = _corners(spark, sf_dir)
    edge = s.automatic_edge(faces, median_spacing(points))
    return _triple(s.filter_faces(faces, edge).where("kept"), F.round(F.lit(edge), 6).alias("threshold"))


def raster_depth(spark, sf_dir):
    points, faces = _corners(spark, sf_dir)
    cells = s.raster(s.filter_faces(faces, MANUAL_EDGE), s.grid_of(points, PIXEL))
    return cells.select("row", "col", F.round("depth", 6).alias("depth"))


def nn_spacing(spark, sf_dir):
    return nearest_distances(tin_points(spark, sf_dir)).select("pid", F.round("distance", 6).alias("distance"))


def mesh_vertices(spark, sf_dir):
    points, faces = _corners(spark, sf_dir)
    return s.mesh(points, s.filter_faces(faces, MANUAL_EDGE))[0]


def las_points(spark, sf_dir):
    return las_records(tin_points(spark, sf_dir))[0].select("x", "y", "z", "intensity")


def xyz_lines(spark, sf_dir):
    def lines(batches):
        for b in batches:
            b["line"] = [xyz_line(*r) for r in zip(b["x_m"] / 7, b["y_m"] / 7, b["depth_m"], strict=True)]
            yield b[["pid", "line"]]

    return tin_points(spark, sf_dir).select("pid", "x_m", "y_m", "depth_m").mapInPandas(lines, "pid long, line string")


def mavlink_crc(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_name", crc16_column(F.encode("n_name", "UTF-8")).alias("crc"))


def frame(msgid: int, payload: bytes, v2: bool = False) -> bytes:
    """A frame with a right CRC."""
    head = struct.pack("<BBBBBBH", len(payload), 0, 0, 0, 1, 1, msgid) + b"\0" if v2 else struct.pack("<BBBBB", len(payload), 0, 1, 1, msgid)
    body = head + payload
    return bytes([mavlink.V2 if v2 else mavlink.V1]) + body + struct.pack("<H", crc16(bytes([mavlink.MESSAGES[msgid][0]]), crc16(body)))


def log_frames(spark, sf_dir):
    """Frames of one log for each nation, built from its key."""

    def build(batches):
        for b in batches:
            for key in b["n_nationkey"]:
                data = b"\xbbU" + frame(2, struct.pack("<QI", 1_790_845_947_987_000 + int(key), 310_767)) + frame(24, struct.pack("<QiiiHHHHBB", 320_767_000, 559_345_784 - int(key), 373_812_133, 183_645, 100, 100, 0, 0, 6, 30), True) + b"\xfe\0"
                found = list(mavlink.frames(data))
                import pandas as pd

                yield pd.DataFrame({"path": str(key), "offset": [f[0] for f in found], "msgid": [f[1] for f in found], "bad_crc": [f[2] is None for f in found], "payload": [f[2] for f in found]})

    return _table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(build, mavlink.FRAMES)


def mavlink_decode(spark, sf_dir):
    return mavlink.gps_with_utc(log_frames(spark, sf_dir)).withColumn("time_usec", F.col("time_usec").cast("long"))


def boot_epoch(spark, sf_dir):
    return mavlink.boot_epochs(log_frames(spark, sf_dir))


def surface_report(spark, sf_dir):
    """What the report says of spacing, raster, edges, triangles, depths and LAS scaling, with automatic edge and pixel."""
    points, faces = _corners(spark, sf_dir)
    spacing = median_spacing(points)
    pixel, edge = s.automatic_pixel(spacing), s.automatic_edge(faces, spacing)
    grid, las = s.grid_of(points, pixel), las_records(points)[1]
    kept = s.filter_faces(faces, edge).agg(F.count("*").alias("triangles_before_filter"), F.count_if("kept").alias("triangles_after_filter"))
    depths = points.agg(F.min("depth_m").alias("minimum_depth_m"), F.max("depth_m").alias("maximum_depth_m"))
    fixed = {"median_spacing_m": round(spacing, 6), "pixel_size_m": round(pixel, 6), "max_triangle_edge_m": round(edge, 6), "raster_width": grid["width"], "raster_height": grid["height"], **{f"las_scale_{c}": v for c, v in zip("xyz", las["scales"], strict=True)}, **{f"las_offset_{c}": v for c, v in zip("xyz", las["offsets"], strict=True)}}
    return kept.crossJoin(depths).select("*", *(F.lit(v).alias(n) for n, v in fixed.items()))  # one row each


NAMES = (surface_report, qc_status, numeric_parse, project_utm, duplicates, accepted_points, survey_report, tin_faces, face_edges, face_filter_manual, face_filter_auto, raster_depth, nn_spacing, mesh_vertices, las_points, xyz_lines, mavlink_crc, mavlink_decode, boot_epoch)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


_DUP = f"""{_FLAGGED}, ranked AS (SELECT *, CASE WHEN reason = '' THEN row_number() OVER (PARTITION BY reason, xr, yr ORDER BY source_row) ELSE 0 END AS rn FROM keyed),
cells AS (SELECT xr, yr, median(depth) AS d, median(beam) AS b, count(*) AS n FROM keyed WHERE reason = '' GROUP BY xr, yr)"""
_MEDIAN = "spacing AS (SELECT median(d) AS m FROM (SELECT min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))) AS d FROM pts a JOIN pts b ON a.pid <> b.pid GROUP BY a.pid))"
_LIMIT = "limits AS (SELECT CASE WHEN (SELECT min(e) FROM edges) <= 4.0::DOUBLE * m THEN 4.0::DOUBLE * m ELSE 1.001::DOUBLE * (SELECT min(e) FROM edges) END AS t FROM spacing)"
#: The clock of log_frames's only system time, less its time since boot.
_EPOCH = "(1790845947987000 + n_nationkey - 310767000)::DOUBLE / 1e6::DOUBLE"
ORACLE_SQL = {
    "qc_status": f"WITH {_FLAGGED} SELECT CASE WHEN reason = '' THEN 'valid' ELSE 'rejected' END AS quality_status, reason AS quality_reason, count(*) AS rows FROM judged GROUP BY 1, 2",
    "numeric_parse": f"WITH {_FLAGGED} SELECT source_row, lat, lon, beam FROM parsed",
    "project_utm": f"WITH {_FLAGGED} SELECT source_row, round(x, 3) AS x, round(y, 3) AS y FROM placed WHERE x IS NOT NULL",
    "duplicates": f"WITH {_DUP} SELECT source_row, CASE WHEN reason <> '' THEN 'rejected' WHEN rn > 1 THEN 'suspect' ELSE 'valid' END AS quality_status, CASE WHEN rn > 1 THEN '{q.DUPLICATE}' ELSE reason END AS quality_reason FROM ranked",
    "accepted_points": f"WITH {_DUP} SELECT xr AS x_round, yr AS y_round, round(d, 6) AS depth_m, round(b, 6) AS beam_distance_m, n AS sample_count FROM cells",
    "survey_report": f"WITH {_DUP} SELECT (SELECT count(*) FROM ranked) AS source_rows, (SELECT count(*) FROM ranked WHERE reason <> '') AS rejected_rows, (SELECT count(*) FROM ranked WHERE rn > 1) AS suspect_rows, count(*) AS accepted_aggregated_points, round(min(d), 6) AS minimum_depth_m, round(max(d), 6) AS maximum_depth_m FROM cells",
    "tin_faces": f"WITH {_TIN} SELECT p, q, r FROM good",
    "face_edges": f"WITH {_TIN} SELECT p, q, r, round(e, 6) AS max_edge_m FROM edges",
    "face_filter_manual": f"WITH {_TIN} SELECT p, q, r FROM edges WHERE e <= {MANUAL_EDGE}",
    "face_filter_auto": f"WITH {_TIN}, {_MEDIAN}, {_LIMIT} SELECT p, q, r, round(t, 6) AS threshold FROM edges, limits WHERE e <= t",
    "raster_depth": f"""WITH {_TIN}, ext AS (SELECT min(x_m) w, max(x_m) e, min(y_m) s, max(y_m) n FROM pts),
grid AS (SELECT r.v::INT AS "row", c.v::INT AS col, w + (c.v + 0.5::DOUBLE) * {PIXEL}::DOUBLE AS px, n - (r.v + 0.5::DOUBLE) * {PIXEL}::DOUBLE AS py FROM ext,
  (SELECT unnest(range(1000)) AS v) r, (SELECT unnest(range(1000)) AS v) c WHERE r.v < greatest(1, ceil((n - s) / {PIXEL}::DOUBLE)) AND c.v < greatest(1, ceil((e - w) / {PIXEL}::DOUBLE))),
hit AS (SELECT "row", col, p, q, r, e, ad, bd, cd, (("by"-cy)*(px-cx)+(cx-bx)*(py-cy)) / (("by"-cy)*(ax-cx)+(cx-bx)*(ay-cy)) AS l1, ((cy-ay)*(px-cx)+(ax-cx)*(py-cy)) / (("by"-cy)*(ax-cx)+(cx-bx)*(ay-cy)) AS l2
  FROM edges JOIN grid ON px BETWEEN least(ax, bx, cx) - 1 AND greatest(ax, bx, cx) + 1 AND py BETWEEN least(ay, "by", cy) - 1 AND greatest(ay, "by", cy) + 1),
best AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY p, q, r) AS k FROM hit WHERE least(l1, l2, 1 - l1 - l2) >= -1e-12)
SELECT "row", col, round(l1 * ad + l2 * bd + (1 - l1 - l2) * cd, 6) AS depth FROM best WHERE k = 1 AND e <= {MANUAL_EDGE}""",
    "surface_report": f"""WITH {_TIN}, {_MEDIAN}, {_LIMIT}, px AS (SELECT greatest(m / 2, 0.05::DOUBLE) AS p FROM spacing), ext AS (SELECT min(x_m) w, max(x_m) e, min(y_m) s, max(y_m) n, min(depth_m) lo, max(depth_m) hi FROM pts)
SELECT (SELECT count(*) FROM edges) AS triangles_before_filter, (SELECT count(*) FROM edges WHERE e <= t) AS triangles_after_filter, lo AS minimum_depth_m, hi AS maximum_depth_m, round(m, 6) AS median_spacing_m, round(p, 6) AS pixel_size_m, round(t, 6) AS max_triangle_edge_m,
  CAST(greatest(1, ceil((e - w) / p)) AS INT) AS raster_width, CAST(greatest(1, ceil((n - s) / p)) AS INT) AS raster_height, 0.001::DOUBLE AS las_scale_x, 0.001::DOUBLE AS las_scale_y, 0.001::DOUBLE AS las_scale_z, w AS las_offset_x, s AS las_offset_y, -hi AS las_offset_z FROM ext, px, limits, spacing""",
    "mavlink_crc": """SELECT n_name, CAST(list_reduce(list_prepend(65535::BIGINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(substr(n_name, i, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 33800))) AS INT) AS crc FROM nation""",
    "mavlink_decode": f"""SELECT CAST(n_nationkey AS VARCHAR) AS path, 22::BIGINT AS "offset", 320767000::BIGINT AS time_usec, (559345784 - n_nationkey)::DOUBLE / 1e7::DOUBLE AS lat_deg, 373812133::DOUBLE / 1e7::DOUBLE AS lon_deg,
  183645::DOUBLE / 1000::DOUBLE AS alt_m, 6::INT AS fix_type, {_EPOCH} + 320767000::DOUBLE / 1e6::DOUBLE AS utc_s FROM nation""",
    "boot_epoch": f"SELECT CAST(n_nationkey AS VARCHAR) AS path, {_EPOCH} AS boot_epoch_s, 0::BIGINT AS frames_bad_crc FROM nation",
    "nn_spacing": f"WITH {_PIDS} SELECT a.pid, round(min(sqrt((a.x_m-b.x_m)*(a.x_m-b.x_m)+(a.y_m-b.y_m)*(a.y_m-b.y_m))), 6) AS distance FROM pts a JOIN pts b ON a.pid <> b.pid GROUP BY a.pid",
    "mesh_vertices": f"WITH {_TIN}, used AS (SELECT p AS pid FROM edges WHERE e <= {MANUAL_EDGE} UNION SELECT q FROM edges WHERE e <= {MANUAL_EDGE} UNION SELECT r FROM edges WHERE e <= {MANUAL_EDGE}) SELECT row_number() OVER (ORDER BY pid) - 1 AS vid, x_m - (SELECT min(x_m) FROM pts) AS x, y_m - (SELECT min(y_m) FROM pts) AS y, -depth_m AS z FROM pts JOIN used USING (pid)",
    "las_points": f"WITH {_PIDS}, lo AS (SELECT min(x_m) x, min(y_m) y, min(-depth_m) z FROM pts) SELECT CAST(round_even((x_m - x) / 0.001::DOUBLE, 0) AS INT) AS x, CAST(round_even((y_m - y) / 0.001::DOUBLE, 0) AS INT) AS y, CAST(round_even((-depth_m - z) / 0.001::DOUBLE, 0) AS INT) AS z, CAST(trunc(greatest(0, least(beam_distance_m * 1000, 65535))) AS INT) AS intensity FROM pts, lo",
    "xyz_lines": f"WITH {_PIDS} SELECT pid, printf('%.4f %.4f %.4f', x_m / 7, y_m / 7, depth_m) AS line FROM pts",
}
