"""WGS 84 longitude and latitude to UTM or web Mercator, as SQL expressions that run inside generated code.

Transverse Mercator is Krueger's series to the sixth order (Karney 2011). Other reference systems are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.errors import ProcessingError

# WGS 84 and UTM; fixed values
AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EASTING, FALSE_NORTHING = 500000.0, 10000000.0


def _series(n: float) -> list[float]:
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]


def parse_crs(name: str) -> int:
    m = re.fullmatch(r"\s*(?:EPSG\s*:\s*)?(\d{4,5})\s*", name or "", re.I)
    code = int(m[1]) if m else 0
    if code in (4326, 3857) or (code // 100 in (326, 327) and 1 <= code % 100 <= 60):
        return code
    raise ProcessingError(f"Unknown or unsupported reference system: {name}")


def check_crs(input_crs: str, output_crs: str) -> int:
    """The output's code, if both are known and the output is projected."""
    if parse_crs(input_crs) != 4326:
        raise ProcessingError(f"Input coordinates must be EPSG:4326, not {input_crs}.")
    code = parse_crs(output_crs)
    if code == 4326:
        raise ProcessingError("The output reference system must be projected.")
    return code


def _parts(code: int) -> dict[str, str]:
    """SQL text of the steps, each named and over the earlier ones' names; `x` and `y` last."""
    d = lambda v: f"cast('{v!r}' AS double)"
    if code == 3857:
        return {"x": f"{d(AXIS)} * radians(lon)", "y": f"{d(AXIS)} * asinh(tan(radians(lat)))"}
    n = FLATTENING / (2 - FLATTENING)
    e = 2 * n**0.5 / (1 + n)
    radius = SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = list(enumerate(_series(n), 1))
    east = " + ".join(["eta", *(f"{d(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in alpha)])
    north = " + ".join(["xi", *(f"{d(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in alpha)])
    return {
        "lam": f"radians(lon - ({6 * (code % 100) - 183}))",
        "s": "sin(radians(lat))",
        "t": f"sinh(atanh(s) - {d(e)} * atanh({d(e)} * s))",
        "xi": "atan2(t, cos(lam))",
        "eta": "asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam)))",
        "x": f"{d(FALSE_EASTING)} + {d(radius)} * ({east})",
        "y": f"{d(FALSE_NORTHING if code // 100 == 327 else 0.0)} + {d(radius)} * ({north})",
    }


def projection_query(source: str, code: int) -> str:
    """SQL over a relation with lon and lat in degrees: its columns, the steps, x and y. The text runs in any engine with hyperbolic functions."""
    for name, text in _parts(code).items():
        source = f"SELECT *, {text} AS {name} FROM ({source}) AS p_{name}"
    return source


def project(df: DataFrame, lon: str, lat: str, x: str, y: str, code: int, where: Column) -> DataFrame:
    """`df` with x and y; null outside `where` and where the formula has no finite value (poles, points near a quarter turn from the meridian).

    Each step is bound to its name by a one-element array, so it is computed once. The point comes out of a generator of one row:
    the optimizer, which would put its whole text in the place of each later use, cannot look through that.
    """
    far = F.lit(False) if code == 3857 else F.abs(F.pmod(F.col(lon) - (6 * (code % 100) - 183) + 180, F.lit(360.0)) - 180) > 80
    good = where & ~far & (F.abs(F.col(lat)) < 90)
    parts = _parts(code)
    text = f"named_struct('x', {parts.pop('x')}, 'y', {parts.pop('y')})"
    for name, step in reversed([("lon", f"`{lon}`"), ("lat", f"`{lat}`"), *parts.items()]):
        text = f"element_at(transform(array({step}), {name} -> {text}), 1)"
    point = df.select("*", F.explode(F.array(F.when(good, F.expr(text)))).alias("_point"))
    fine = (F.abs(F.col("_point.x")) < 1e9) & (F.abs(F.col("_point.y")) < 1e9)
    return point.withColumns({x: F.when(fine, F.col("_point.x")), y: F.when(fine, F.col("_point.y"))}).drop("_point")
