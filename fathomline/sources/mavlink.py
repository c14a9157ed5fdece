"""MAVLink messages in binary logs: system time, raw GPS and global position, by file and place."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.crc import crc16

# fixed values of the protocol: message id -> (CRC extra, least payload, full payload); start bytes; header sizes
MESSAGES = {2: (137, 12, 12), 24: (24, 30, 52), 33: (104, 28, 28)}
V1, V2 = 0xFE, 0xFD
HEADERS = {V1: 6, V2: 10}
SIGNATURE = 13
#: Clocks that were never set tell earlier years; those past year 9999 are none either.
FIRST_VALID_USEC, LAST_VALID_USEC = 946_684_800_000_000, 253_402_300_800_000_000
FRAMES = "path string, offset long, msgid int, bad_crc boolean, payload binary"
_START = re.compile(rb"[\xfe\xfd]")


def frame_at(data: bytes, i: int) -> tuple[int, int, bytes | None] | None:
    """(end, message id, full-length payload, or None when the CRC is wrong), or None: no known frame starts here."""
    kind = data[i]
    size = HEADERS[kind]
    if i + size > len(data):
        return None
    n = data[i + 1]
    if kind == V1:
        msgid, extra = data[i + 5], 0
    else:
        msgid, extra = int.from_bytes(data[i + 7 : i + 10], "little"), SIGNATURE * (data[i + 2] & 1)
    if msgid not in MESSAGES:
        return None
    seed, least, full = MESSAGES[msgid]
    if not (least if kind == V1 else 1) <= n <= full:
        return None
    stop = i + size + n
    if stop + 2 + extra > len(data):
        return None
    if crc16(bytes([seed]), crc16(data[i + 1 : stop])) != int.from_bytes(data[stop : stop + 2], "little"):
        return stop + 2 + extra, msgid, None
    return stop + 2 + extra, msgid, data[i + size : stop].ljust(full, b"\0")


def frames(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(place, message id, payload or None for a wrong CRC), left to right; only a good frame is stepped over as a whole."""
    at = 0
    while m := _START.search(data, at):
        i = m.start()
        found = frame_at(data, i)
        at = i + 1
        if found:
            end, msgid, payload = found
            yield i, msgid, payload
            if payload is not None:
                at = end


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All known frames of all files at `path`; files are read side by side."""

    def scan(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                name, data = batch.column("path")[row].as_py(), batch.column("content")[row].as_py()
                found = list(frames(data))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] is None for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.binary())], ["path", "offset", "msgid", "bad_crc", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, FRAMES)


def _unsigned(at: int, n: int):
    """Little-endian unsigned number of n bytes; its digits pass through hex, so 64 bits fit."""
    digits = F.concat(*(F.hex(F.expr(f"substring(payload, {at + j + 1}, 1)")) for j in reversed(range(n))))
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def _signed(at: int):
    v = _unsigned(at, 4).cast("long")
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def system_times(frames_: DataFrame) -> DataFrame:
    """path, offset, time_unix_usec, time_boot_ms, is_valid, boot_epoch_s, utc."""
    rows = frames_.where("msgid = 2 AND NOT bad_crc").select("path", "offset", _unsigned(0, 8).alias("time_unix_usec"), _unsigned(8, 4).cast("long").alias("time_boot_ms"))
    usec = F.col("time_unix_usec")
    valid = (usec >= FIRST_VALID_USEC) & (usec < LAST_VALID_USEC)
    epoch = (usec - F.col("time_boot_ms") * 1000).cast("double") / 1e6
    return rows.withColumns({"is_valid": valid, "boot_epoch_s": epoch, "utc": F.when(valid, F.timestamp_micros(F.when(valid, usec).cast("long")))})


def gps_raw(frames_: DataFrame) -> DataFrame:
    return frames_.where("msgid = 24 AND NOT bad_crc").select("path", "offset", _unsigned(0, 8).alias("time_usec"), (_signed(8) / 1e7).alias("lat_deg"), (_signed(12) / 1e7).alias("lon_deg"), (_signed(16) / 1000.0).alias("alt_m"), _unsigned(28, 1).cast("int").alias("fix_type"))


def global_positions(frames_: DataFrame) -> DataFrame:
    return frames_.where("msgid = 33 AND NOT bad_crc").select("path", "offset", _unsigned(0, 4).cast("long").alias("time_boot_ms"), (_signed(4) / 1e7).alias("lat_deg"), (_signed(8) / 1e7).alias("lon_deg"), (_signed(12) / 1000.0).alias("alt_m"))


def boot_epochs(frames_: DataFrame) -> DataFrame:
    """path, boot_epoch_s (median over valid system times, else null), frames_bad_crc: one row for each file with frames."""
    bad = frames_.groupBy("path").agg(F.count_if("bad_crc").alias("frames_bad_crc"))
    epoch = system_times(frames_).where("is_valid").groupBy("path").agg(F.median("boot_epoch_s").alias("boot_epoch_s"))
    return bad.join(epoch, "path", "left").select("path", "boot_epoch_s", "frames_bad_crc")


def gps_with_utc(frames_: DataFrame) -> DataFrame:
    """GPS messages with utc_s: the file's boot epoch plus their time since boot; null without an epoch."""
    return gps_raw(frames_).join(boot_epochs(frames_).select("path", "boot_epoch_s"), "path", "left").withColumn("utc_s", F.col("boot_epoch_s") + F.col("time_usec").cast("double") / 1e6).drop("boot_epoch_s")
