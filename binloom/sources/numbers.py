"""Samples from text files, one whole number a line."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value BIGINT) of text files, a number a line. Blank lines are skipped; anything else that isn't a number from 0 on fails the job."""
    return numbers_in(spark.read.text(path))


def numbers_in(lines: DataFrame, line: str = "value") -> DataFrame:
    """The same of a table of lines."""
    text = lines.select(F.trim(line).alias("value")).where("value <> ''")
    wide = F.col("value").cast("decimal(20,0)")
    bad = F.raise_error(F.concat(F.lit("not a whole number: "), F.col("value"))).cast("bigint")
    small = F.col("value").cast("decimal(20,0)") < F.lit(Decimal(1 << 63))
    folded = F.when(small, wide).otherwise(wide - F.lit(Decimal(1 << 64))).cast("bigint")
    return text.select(F.when(F.col("value").rlike(r"^\+?\d{1,20}$"), folded).otherwise(bad).alias("value"))
