"""What a run is told, and what an inspection tells."""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from fathomline.errors import ProcessingError


@dataclass(frozen=True)
class CsvInspection:
    columns: list[str]
    row_count: int
    delimiter: str
    encoding: str


@dataclass(frozen=True)
class ProcessingConfig:
    input_csv: Path
    output_dir: Path
    latitude_field: str
    longitude_field: str
    beam_distance_field: str
    input_crs: str = "EPSG:4326"
    output_crs: str = "EPSG:32637"
    source_gnss_transducer_offset_applied: bool = True
    water_surface_to_transducer_m: float = 0.15
    pixel_size_m: float | None = None
    max_triangle_edge_m: float | None = None
    min_depth_m: float = 0.05
    max_depth_m: float = 100.0

    def validated(self) -> ProcessingConfig:
        """Also refuses NaN and infinite numbers, which comparisons alone would let through."""
        numbers = [self.water_surface_to_transducer_m, self.min_depth_m, self.max_depth_m, *(v for v in (self.pixel_size_m, self.max_triangle_edge_m) if v is not None)]
        if not all(map(math.isfinite, numbers)):
            raise ProcessingError("Numbers of the configuration must be finite.")
        if self.water_surface_to_transducer_m < 0:
            raise ProcessingError("The distance from water surface to transducer must not be negative.")
        if self.min_depth_m >= self.max_depth_m:
            raise ProcessingError("The least depth must be below the greatest depth.")
        for name in ("pixel_size_m", "max_triangle_edge_m"):
            if (v := getattr(self, name)) is not None and v <= 0:
                raise ProcessingError(f"{name} must be above zero.")
        return self
