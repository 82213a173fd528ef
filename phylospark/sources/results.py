"""Result lines: one dictionary in Python's notation on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "GenTreeSize bigint, TreeSize bigint, NumBiopsies bigint, biopsy_size double, RPercentile double, Result double"


def record(line: Column) -> Column:
    """The fields of a line: quotes and brackets become those of JSON."""
    return F.from_json(F.translate(line, "'()", '"[]'), SCHEMA)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(record(F.col("value")).alias("r")).select("r.*")
