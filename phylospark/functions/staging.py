"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_phylospark_core", None) or f"file://{tempfile.mkdtemp(prefix='phylospark-')}"
        spark._phylospark_core = folder
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, never to be broadcast. Spark judges a staged table, and what is made of it, by the size of its files;
    short numbers are a hundredth of their size there, and the driver would hold the whole side."""
    return df.hint("merge")
