"""Delimited text with columns named in its header, all read as strings."""

from __future__ import annotations

import codecs
import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.checkpoints import settled
from fathomline.config import CsvInspection
from fathomline.errors import ProcessingError

SNIFF_BYTES = 65_536
# fixed values: encodings in the order they are tried, delimiters, and texts that count as missing
ENCODINGS = ("utf-8-sig", "cp1251", "latin-1")
DELIMITERS = ",;\t|"
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CANDIDATES = {"latitude": ("latitude", "lat"), "longitude": ("longitude", "lon"), "beam_distance": ("beam distance", "beam_distance", "depth")}
SPARK_NAMES = {"utf-8-sig": "UTF-8", "cp1251": "windows-1251", "latin-1": "ISO-8859-1"}
BAD = "_unparsed_line"


def head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the file, through Spark's file systems."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(conf)
    if not store.exists(where) or store.getFileStatus(where).isDirectory():
        raise ProcessingError(f"No such file: {path}")
    stream = store.open(where)
    try:
        size = min(SNIFF_BYTES, store.getFileStatus(where).getLen())
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
    finally:
        stream.close()


def sniff(sample: bytes) -> tuple[str, str]:
    """(encoding, delimiter). A character cut off by the end of the sample does not rule its encoding out."""
    for encoding in ENCODINGS:
        try:
            text = codecs.getincrementaldecoder(encoding)().decode(sample, False)
            break
        except UnicodeDecodeError:
            continue
    try:
        return encoding, csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        return encoding, ","


def detect_csv_format(spark: SparkSession, path: str) -> tuple[str, str]:
    return sniff(head(spark, path))


def header(spark: SparkSession, path: str, encoding: str, delimiter: str) -> list[str]:
    """Stripped names; a name that comes again gets .1, .2, ..."""
    text = codecs.getincrementaldecoder(encoding)().decode(head(spark, path), False)
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        raise ProcessingError("The file has no header.")
    names, out = [n.strip() for n in next(csv.reader(lines[:1], delimiter=delimiter))], []
    for n in names:
        again = sum(o == n or o.rsplit(".", 1)[0] == n and o.rsplit(".", 1)[1].isdigit() for o in out if "." in o or o == n)
        out.append(f"{n}.{again}" if again else n)
    return out


def inspect_csv(spark: SparkSession, path: str) -> CsvInspection:
    """Columns, and physical lines less the header's."""
    encoding, delimiter = detect_csv_format(spark, path)
    return CsvInspection(header(spark, path, encoding, delimiter), max(0, spark.read.text(path).count() - 1), delimiter, encoding)


def select_column(names: list[str], kind: str) -> str | None:
    """The first header that is a usual name of `kind`, or None."""
    return next((n for n in names if n.strip().lower() in CANDIDATES[kind]), None)


def number_rows(df: DataFrame, name: str = "source_row", first: int = 2) -> DataFrame:
    """`df` with consecutive numbers in its order: a partition's offset plus the place in it.

    The marked rows are written first: counts and numbers must come from the same partitions. Rows are not shuffled.
    """
    spark = df.sparkSession
    marked = settled(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], first
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets, "_p long, _base long")  # one row for each partition
    return marked.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_base")


def read_delimited(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """All columns as strings, then source_row (2: the first data row). Blank lines are not rows.

    A row with fewer fields than the header has nulls; one with more is an error, and so is a file without rows.
    """
    encoding, delimiter = detect_csv_format(spark, path)
    names = header(spark, path, encoding, delimiter)
    if lacking := [c for c in required if c not in names]:
        raise ProcessingError(f"Columns not in the file: {', '.join(lacking)}")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    raw = spark.read.schema(schema).option("sep", delimiter).option("encoding", SPARK_NAMES[encoding]).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", BAD).option("quote", '"').option("escape", '"').csv(path)
    raw = raw.where(F.col(BAD).isNull() | (F.trim(F.regexp_replace(BAD, r"\s", "")) != ""))
    fields_in = F.size(F.split(F.regexp_replace(BAD, r'"[^"]*"', ""), f"[{delimiter}]" if delimiter != "\t" else "\t"))
    if raw.where(fields_in > len(names)).take(1):  # all columns: with fewer, Spark does not see long lines
        raise ProcessingError("A row has more fields than the header.")
    missing = lambda c: F.when(~F.col(c).isin(*MISSING), F.col(c))
    table = raw.select(*(missing(f"c{i}").alias(n) for i, n in enumerate(names)))
    if not table.take(1):
        raise ProcessingError("The file has no rows.")
    return number_rows(table)
