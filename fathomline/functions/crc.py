"""CRC-16/MCRF4XX, a byte at a time through a table, as a function and as a column expression."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the checksum: reflected polynomial and start
POLYNOMIAL, START = 0x8408, 0xFFFF


def _remainder(byte: int) -> int:
    """What a byte leaves after its eight bits are divided by the polynomial."""
    return reduce(lambda v, _: v >> 1 ^ (POLYNOMIAL if v & 1 else 0), range(8), byte)


TABLE = tuple(map(_remainder, range(256)))


def crc16(data: bytes, crc: int = START) -> int:
    return reduce(lambda v, byte: TABLE[(v ^ byte) % 256] ^ v >> 8, data, crc)


def crc16_column(data: Column) -> Column:
    """The same of a binary column, in built-in functions; null for null."""
    table = F.array(*map(F.lit, TABLE))
    digits = F.transform(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda d: F.conv(d, 16, 10).cast("int"))
    bytes_ = F.filter(digits, lambda b: b.isNotNull())
    step = lambda v, b: F.get(table, v.bitwiseXOR(b).bitwiseAND(F.lit(255))).bitwiseXOR(F.shiftright(v, 8))
    return F.aggregate(bytes_, F.lit(START), step)
