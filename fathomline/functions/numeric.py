"""Numbers as they are typed: decimal commas, padding, and nothing that is not a plain decimal."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalize_numeric(text: Column) -> Column:
    """Double, or null. Every comma becomes a point, so `1,234.5` is no number; nor are `1d`, `1_000`, `0x10`."""
    clean = F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(","), F.lit("."))
    return F.when(clean.rlike(PLAIN), clean.try_cast("double"))
