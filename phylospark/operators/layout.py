"""Layout tables for drawing trees; drawing itself is left to other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions.staging import large
from phylospark.operators import clusters

# The colours of biopsies, in order.
PALETTE = [
    "lightgoldenrodyellow", "#ffcccc", "#ebd0f5", "#d2aaf0", "#d8b3e6", "#9467bd", "#e377c2", "#17becf", "violet", "pink", "olive", "gold", "goldenrod", "antiquewhite", "#ffcccc", "#ff6666", "#ff0000", "#b30000", "#800000",
]


def biopsy_colour(index: Column) -> Column:
    return F.element_at(F.lit(PALETTE), (index % len(PALETTE) + 1).cast("int"))


def tree_layout(nodes: DataFrame, x_scale: float = 1.25, y_scale: float = 1.0) -> DataFrame:
    """(tree_id, node_id, x, y): x is the middle of the node's leaves in order of their node_id, y falls with depth."""
    pairs = clusters.closure(nodes)
    depth = pairs.groupBy("tree_id", "node_id").agg((F.count(F.lit(1)) - 1).alias("depth"))
    inner = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.select("tree_id", "node_id").join(inner, ["tree_id", "node_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id")) - 1
    spread = pairs.join(leaves.withColumn("place", place), ["tree_id", "node_id"]).groupBy("tree_id", F.col("anc").alias("node_id")).agg(((F.min("place") + F.max("place")) / 2).alias("middle"))
    return depth.join(spread, ["tree_id", "node_id"]).select("tree_id", "node_id", (F.col("middle") * x_scale).alias("x"), (-F.col("depth") * y_scale).alias("y"))


def edge_layout(nodes: DataFrame, layout: DataFrame, text: Column) -> DataFrame:
    """(tree_id, parent_id, child_id, mid_x, mid_y, colour, hover): an edge is red if its text says something, else green."""
    ends = nodes.where("parent_id IS NOT NULL").select("tree_id", "parent_id", F.col("node_id").alias("child_id"), text.alias("hover"))
    a = layout.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = layout.select("tree_id", F.col("node_id").alias("child_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    rows = ends.join(a, ["tree_id", "parent_id"]).join(b, ["tree_id", "child_id"])
    return rows.select("tree_id", "parent_id", "child_id", ((F.col("x0") + F.col("x1")) / 2).alias("mid_x"), ((F.col("y0") + F.col("y1")) / 2).alias("mid_y"), F.when(F.coalesce("hover", F.lit("")) == "", "green").otherwise("red").alias("colour"), "hover")


def distance_text(weight: Column) -> Column:
    return F.format_string("Distance: %.2f", weight)


def highlights(nodes: DataFrame, biopsy: DataFrame) -> DataFrame:
    """(run_id, node_id, level, colour): nodes whose cell was sampled, for each biopsy that holds it."""
    sampled = biopsy.select("run_id", "cell_id", "level").distinct()
    return nodes.select("run_id", "node_id", "cell_id").join(sampled, ["run_id", "cell_id"]).select("run_id", "node_id", "level", biopsy_colour(F.col("level")).alias("colour"))


def visible(nodes: DataFrame, only: DataFrame, biopsy: DataFrame) -> DataFrame:
    """Nodes of the list only (run_id, node_id), and those whose cell was sampled."""
    sampled = nodes.join(biopsy.select("run_id", "cell_id").distinct(), ["run_id", "cell_id"], "left_semi").select("run_id", "node_id")
    return nodes.join(only.select("run_id", "node_id").union(sampled).distinct(), ["run_id", "node_id"], "left_semi")


def layered_layout(nodes: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(run_id, node_id, x, y) of reconstructed trees: the rank within a level by pin (run_id, level, cell_id, pin), then cell_id;
    nodes without a cell stand left and right in turn, each half a step further in."""
    rows = nodes.withColumn("pin", F.lit(None).cast("int")) if pins is None else nodes.join(large(pins), ["run_id", "level", "cell_id"], "left")
    rank = F.row_number().over(Window.partitionBy("run_id", "level").orderBy(F.col("pin").asc_nulls_last(), "cell_id", "node_id")) - 1
    levels = nodes.groupBy("run_id").agg(F.countDistinct("level").alias("levels"))
    turn = F.row_number().over(Window.partitionBy("run_id", F.col("cell_id").isNull()).orderBy("level"))
    rows = rows.withColumns({"rank": rank, "turn": turn}).join(large(levels), "run_id")
    offset = 0.25 + 0.5 * (F.col("turn") - 1)
    x = F.when(F.col("cell_id").isNotNull(), F.col("rank").cast("double")).when(F.col("turn") % 2 == 1, offset).otherwise(F.col("levels") - offset)
    return rows.select("run_id", "node_id", x.alias("x"), F.col("level").alias("y"))


def extent(layout: DataFrame, x_scale: float = 1.0, y_scale: float = 1.0) -> DataFrame:
    """(tree_id, min_x, max_x, min_y, max_y), scaled: where a legend goes."""
    return layout.groupBy("tree_id").agg(*((f(c) * s).alias(f"{n}_{c}") for c, s in (("x", x_scale), ("y", y_scale)) for n, f in (("min", F.min), ("max", F.max))))
