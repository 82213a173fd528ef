"""Profiles as text (a line with > and the cell, a line with its copies) and distance matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospark.functions.staging import stage


def one_file(rows: DataFrame) -> DataFrame:
    """Rows whose order in their file counts: of several files there is none."""
    files = rows.inputFiles()
    if len(files) > 1:
        raise ValueError(f"the order of rows is that of one file, not of {len(files)}")
    return rows


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows straight from a file reader with their place over all files, files in the order of their names.

    Files are read in splits by as many tasks as there are splits. A split is known by its file and first byte, and its rows come in order, so
    a prefix sum over the number of rows of each split places them: one short row a split is all that one task orders."""
    file, start, at = "__file", "__start", "__at"
    own = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start))
    own = stage(own.withColumn(at, F.monotonically_increasing_id()), "lines")
    splits = own.groupBy(file, start).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first"))
    before = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are splits
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return own.join(splits, [file, start]).withColumn(name, F.col("__before") + F.col(at) - F.col("__first")).drop(file, start, at, "__n", "__first", "__before")


def profile_lines(profiles: DataFrame) -> DataFrame:
    """(ord, value): both lines of each profile (ord, cell_id, genome)."""
    return profiles.select("ord", F.concat(F.lit(">"), F.col("cell_id").cast("string"), F.lit("\n"), F.array_join(F.transform("genome", lambda c: c.cast("string")), ",")).alias("value"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Text files whose names have the order of ord, as many as it takes."""
    profile_lines(profiles).orderBy("ord").select("value").write.mode("overwrite").text(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(ord, cell_id, genome) in the order of the files' names and lines; identifiers may repeat."""
    rows = in_order(spark.read.text(path, lineSep=">").where(F.trim("value") != ""), "ord")
    parts = F.split(F.trim("value"), "\\r?\\n")
    return rows.select(F.col("ord").cast("int").alias("ord"), parts[0].cast("int").alias("cell_id"), F.transform(F.split(parts[1], ","), lambda c: F.trim(c).cast("int")).alias("genome"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, id_i, id_j, dist) of a file whose first line counts the rows; each row has an identifier and its distances."""
    rows = in_order(one_file(spark.read.text(path)).where(F.trim("value") != ""), "i")
    rows = rows.withColumn("i", (F.col("i") - 1).cast("int")).where("i >= 0")
    parts = F.split(F.trim("value"), "\\s+")
    rows = rows.select("i", parts[0].cast("int").alias("id_i"), F.posexplode(F.transform(F.slice(parts, 2, F.size(parts)), lambda v: v.cast("double"))).alias("j", "dist"))
    ids = rows.where("j = 0").select(F.col("i").alias("j"), F.col("id_i").alias("id_j"))
    return rows.join(ids, "j").select("i", "j", "id_i", "id_j", "dist")


def matrix_lines(distances: DataFrame, *by: str) -> DataFrame:
    """(by, i, value): the rows of the text form, without the count; by are columns that name matrices."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", "dist"))), lambda c: c["dist"].cast("string"))
    return distances.groupBy(*by, "i", "id_i").agg(cells.alias("cells")).select(*by, "i", F.concat_ws(" ", F.col("id_i").cast("string"), "cells").alias("value"))


def write_matrix(distances: DataFrame, path: str) -> None:
    """One matrix as one text file: the number of rows, then the rows in order."""
    rows = matrix_lines(distances)
    count = rows.agg(F.lit(-1).alias("i"), F.count(F.lit(1)).cast("string").alias("value"))
    rows.select(F.col("i").cast("int").alias("i"), "value").unionByName(count).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)
