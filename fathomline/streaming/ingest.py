"""Soundings that arrive as files in a folder: the row checks as a stream. Not in the batch products; duplicates need the whole survey."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.config import ProcessingConfig
from fathomline.operators.quality import flag_quality


def quality_stream(spark: SparkSession, folder: str, columns: list[str], config: ProcessingConfig, delimiter: str = ",") -> DataFrame:
    """Flagged rows of every file put into `folder`. source_row is null: a stream has no row order."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.schema(schema).option("header", True).option("sep", delimiter).csv(folder)
    return flag_quality(rows.withColumn("source_row", F.lit(None).cast("long")), config)
