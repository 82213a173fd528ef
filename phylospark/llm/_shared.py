"""Helpers that the corpus operators share: the shared folder, staged tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, and that Arrow hands over at once (Spark's own limit is 64 MB and 10,000 rows).
SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_phylospark_shared", None) or f"file://{tempfile.mkdtemp(prefix='phylospark-')}"
        spark._phylospark_shared = folder
    return folder.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session, so that what executors hold outside their heaps doesn't follow the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._phylospark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._phylospark_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds over a part of so many of all rows; so there are fewer hot keys than this.
HOT = 1000


def by_heat(table: DataFrame, fits=None) -> tuple[DataFrame, DataFrame]:
    """A staged table that has in n how many rows hold a row's key: the hot keys' rows, to be broadcast, and the others. fits: a condition
    on how long a row is, where rows have no fixed length; long ones are among the others."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = (F.col("n") * HOT > total) & (F.lit(True) if fits is None else fits)
    return F.broadcast(table.where(hot).drop("n")), table.where(~hot).drop("n")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", fits=None) -> DataFrame:
    """rows joined (inner or left) with such a table; no task gathers the rows of a hot key."""
    hot, rest = by_heat(table, fits)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(rest, keys, how))


def without(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not in such a table."""
    hot, rest = by_heat(table)
    return rows.join(hot.select(keys), keys, "left_anti").join(rest.select(keys), keys, "left_anti")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, case ignored."""
    have, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in have:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of a binary column stay near the limit in each piece; one value alone may exceed it."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
