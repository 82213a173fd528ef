"""Biopsies: uniform samples without replacement from generations, of an exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions.rng import uniform


def sample(nodes: DataFrame, generations: list[int], size: int | None = None, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """(run_id, level, ord, node_id, cell_id, genome): level counts biopsies from the earliest, ord is the order of drawing.

    A fraction takes that share of a generation, rounded down; a size takes at most so many. Cells are ranked by a hash, and only
    those within the size leave their task where it is given (Spark limits the rank before it shuffles)."""
    if (size is None) == (fraction is None):
        raise ValueError("give either size or fraction")
    levels = {g: i for i, g in enumerate(generations)}
    rows = nodes.where(F.col("generation").isin(generations))
    rows = rows.withColumn("level", F.element_at(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)), F.col("generation")))
    group = Window.partitionBy("run_id", "generation")
    rank = F.row_number().over(group.orderBy(uniform(seed, F.col("run_id"), F.col("generation"), F.col("node_id"), F.lit("biopsy")), "node_id"))
    rows = rows.withColumn("rank", rank)
    if size is not None:
        rows = rows.where(F.col("rank") <= size)
    else:
        n = nodes.groupBy("run_id", "generation").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(n, ["run_id", "generation"]).where(F.col("rank") <= F.floor(F.col("n") * F.lit(fraction)))
    return rows.select("run_id", "level", (F.col("rank") - 1).alias("ord"), "node_id", "cell_id", "genome")


def pooled(biopsy: DataFrame) -> DataFrame:
    """All biopsies of a run in one level, in order."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("level", "ord")) - 1
    return biopsy.withColumn("ord", place).withColumn("level", F.lit(0))


def cells_by_level(biopsy: DataFrame) -> DataFrame:
    """(run_id, level, cells): what each biopsy holds, for reading."""
    return biopsy.groupBy("run_id", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cell_id"))), lambda c: c["cell_id"]).alias("cells"))


def large_enough(biopsy: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, n_cells) of runs whose biopsies hold enough cells to build a tree."""
    return biopsy.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= least)
