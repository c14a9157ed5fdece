"""Single text files from ordered tables, streamed through the driver a partition at a time."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame


def replace_file(path: Path, chunks: Iterator[bytes]) -> Path:
    """Written beside and renamed, so that a failed run leaves no half file."""
    path = Path(path)
    temporary = path.with_name(f".{path.name}.part")
    with temporary.open("wb") as f:
        for c in chunks:
            f.write(c)
    os.replace(temporary, path)
    return path


def field(v) -> str:
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


class _Line:
    def write(self, text: str) -> None:
        self.text = text


def csv_lines(df: DataFrame) -> Iterator[bytes]:
    line = _Line()
    writer = csv.writer(line, lineterminator="\n")
    writer.writerow(df.columns)
    yield b"\xef\xbb\xbf" + line.text.encode()
    for row in df.toLocalIterator(prefetchPartitions=True):
        writer.writerow([field(v) for v in row])
        yield line.text.encode()


def write_csv(df: DataFrame, path: Path) -> Path:
    """Comma, header, UTF-8 with a byte-order mark; null is an empty field."""
    return replace_file(path, csv_lines(df))


def xyz_line(x: float, y: float, depth: float) -> str:
    """Rounded from the binary value, as C does; Java's formatter would round the shortest decimal."""
    return f"{x:.4f} {y:.4f} {depth:.4f}"


def write_xyz(points: DataFrame, path: Path) -> Path:
    rows = points.select("x_m", "y_m", "depth_m").toLocalIterator(prefetchPartitions=True)
    return replace_file(path, ((xyz_line(*r) + "\n").encode() for r in rows))
