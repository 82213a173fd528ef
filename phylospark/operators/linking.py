"""Reconstruction: cells of each biopsy hang under their nearest possible ancestor of the biopsy before, the earliest are joined.

``candidates`` and ``nearest`` show the steps: an equi-join through the distance table, two predicates and a first-of-group. A cell
without any ancestor is copied into the earlier biopsy, where a later cell may adopt the copy; ``link`` takes a level of all runs at a
time, and ``leaders`` settles in rounds who is copied, so no task works through a run. ``reconstruct`` takes a table of distances,
``reconstruct_within`` measures near pairs only. Neighbour joining of the earliest biopsy is one task's work for a run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions.profiles import regains
from phylospark.functions.staging import large, stage
from phylospark.operators.distance import matrix, near
from phylospark.operators.joining import neighbour_joining

TREE = "run_id string, node_id bigint, parent_id bigint, cell_id bigint, level int, weight double"


def indexed(biopsy: DataFrame, distances: DataFrame) -> DataFrame:
    """Adds at, the cell's row in the matrix; of rows with the same identifier the last counts."""
    rows = distances.where("i = j").groupBy("run_id", F.col("id_i").alias("cell_id")).agg(F.max("i").alias("at"))
    return biopsy.select("run_id", "level", "ord", "cell_id", "genome").join(rows, ["run_id", "cell_id"])


def registered(biopsy: DataFrame, distances: DataFrame) -> DataFrame:
    """(run_id, level, ord, cell_id, node_id): a cell's node bears its identifier in the latest biopsy that holds it; its copies in earlier
    ones get new numbers above the largest identifier, later biopsies first."""
    top = distances.groupBy("run_id").agg(F.max("id_i").alias("top"))
    seen = F.row_number().over(Window.partitionBy("run_id", "cell_id").orderBy(F.col("level").desc(), "ord"))
    rows = biopsy.select("run_id", "level", "ord", "cell_id").withColumn("copy", seen > 1)
    place = F.row_number().over(Window.partitionBy("run_id", "copy").orderBy(F.col("level").desc(), "ord"))
    rows = rows.withColumn("place", place).join(top, "run_id")
    return rows.select("run_id", "level", "ord", "cell_id", F.when(F.col("copy"), F.col("top") + F.col("place")).otherwise(F.col("cell_id")).alias("node_id"))


def candidates(biopsy: DataFrame, distances: DataFrame, radius: float) -> DataFrame:
    """(run_id, level, y_ord, y_cell, x_ord, x_cell, dist, same, excluded): cells x of the biopsy before each y within the radius.

    same: both are one cell; excluded: x lost a locus that y has."""
    cells = indexed(biopsy, distances)
    y = cells.select("run_id", F.col("level"), F.col("ord").alias("y_ord"), F.col("cell_id").alias("y_cell"), F.col("genome").alias("y_genome"), F.col("at").alias("i"))
    x = cells.select("run_id", (F.col("level") + 1).alias("level"), F.col("ord").alias("x_ord"), F.col("cell_id").alias("x_cell"), F.col("genome").alias("x_genome"), F.col("at").alias("j"))
    near = distances.where(F.col("dist") <= radius).select("run_id", "i", "j", "dist")
    rows = y.join(near, ["run_id", "i"]).join(x, ["run_id", "level", "j"])
    return rows.select("run_id", "level", "y_ord", "y_cell", "x_ord", "x_cell", "dist", (F.col("x_cell") == F.col("y_cell")).alias("same"), regains(F.col("x_genome"), F.col("y_genome")).alias("excluded"))


def nearest(found: DataFrame) -> DataFrame:
    """(run_id, level, y_ord, y_cell, x_ord, x_cell, dist) of candidates: the same cell first, else the nearest one that isn't excluded,
    of equals the first in order. Cells without a candidate have no row."""
    allowed = found.where("same OR NOT excluded")
    best = allowed.groupBy("run_id", "level", "y_ord", "y_cell").agg(F.min_by(F.struct("x_ord", "x_cell", "dist"), F.struct(~F.col("same"), F.when(F.col("same"), 0.0).otherwise(F.col("dist")), "x_ord")).alias("x"))
    return best.select("run_id", "level", "y_ord", "y_cell", "x.*")


def closest(distances: DataFrame, radius: float) -> DataFrame:
    """(run_id, x_cell, y_cell, dist) within the radius, from a matrix; of rows with the same identifier the last counts."""
    last = distances.where("i = j").groupBy("run_id", "id_i").agg(F.max("i").alias("i"))
    x, y = last.select("run_id", "i", F.col("id_i").alias("x_cell")), last.select("run_id", F.col("i").alias("j"), F.col("id_i").alias("y_cell"))
    return distances.where(F.col("dist") <= radius).select("run_id", "i", "j", "dist").join(large(x), ["run_id", "i"]).join(large(y), ["run_id", "j"]).select("run_id", "x_cell", "y_cell", "dist")


OPEN, LEADER, FOLLOWER = 0, 1, 2


def leaders(orphans: DataFrame, earlier: DataFrame) -> DataFrame:
    """Those that are copied of cells without an ancestor (run_id, ord): in order, each that no copy before it takes in. earlier (run_id, a, b),
    staged: the cell at a could take in that at b, a before b.

    In rounds over all cells at once: who has a leader before it that could take it in is a follower, who has none and nobody undecided is a leader. There are
    at most two rounds for each step of the longest chain of decisions that hang on each other."""
    state = stage(orphans.select("run_id", "ord", F.lit(OPEN).alias("status")), "orphans")
    while not state.where(F.col("status") == OPEN).isEmpty():
        before = earlier.join(large(state.select("run_id", F.col("ord").alias("a"), "status")), ["run_id", "a"]).groupBy("run_id", F.col("b").alias("ord"))
        before = before.agg(F.max(F.col("status") == LEADER).alias("led"), F.max(F.col("status") == OPEN).alias("waits"))
        now = F.when(F.col("status") != OPEN, F.col("status")).when(F.col("led"), FOLLOWER).when(F.col("waits"), OPEN).otherwise(LEADER)
        state = stage(state.join(large(before), ["run_id", "ord"], "left").select("run_id", "ord", now.alias("status")), "orphans")
    return state.where(F.col("status") == LEADER).select("run_id", "ord")


def link(biopsy: DataFrame, close: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every cell under its nearest possible ancestor of the biopsy before: the nodes (run_id, node_id, cell_id, level, parent_id, weight), parents
    missing in the earliest biopsy; that biopsy's cells (run_id, ord, cell_id, genome, node_id), copies last; and fresh (run_id, fresh), the next free number.

    close: pairs of cells within the radius; top (run_id, top): the largest identifier. A level of all runs at a time, the latest first: cells
    without an ancestor are found at once, ``leaders`` tells which of them are copied into the biopsy before, and then every cell takes the same
    cell, else the nearest of ancestors and copies before it, of equals the first. Only a run's copies are numbered in one window; they all
    end in its earliest biopsy, which one task joins."""
    rank = F.dense_rank().over(Window.partitionBy("run_id").orderBy(F.desc("level")))
    levels = biopsy.select("run_id", "level").distinct().withColumn("back", rank - 1)  # as many rows as a run has biopsies
    cells = biopsy.select("run_id", "level", "ord", "cell_id", "genome").join(large(levels), ["run_id", "level"])
    seen = F.row_number().over(Window.partitionBy("run_id", "cell_id").orderBy("back", "ord"))
    cells = stage(cells.drop("level").withColumn("nth", seen), "cells")
    again = cells.where("nth > 1").select("run_id", "back", "ord", F.row_number().over(Window.partitionBy("run_id").orderBy("back", "ord")).alias("place"))
    number = F.when(F.col("nth") > 1, F.col("top") + F.col("place")).otherwise(F.col("cell_id"))
    placed = cells.join(large(again), ["run_id", "back", "ord"], "left").join(large(top), "run_id")
    cells = stage(placed.select("run_id", "back", "ord", "cell_id", "genome", number.alias("node_id"), "top"), "cells")
    fresh = cells.groupBy("run_id").agg((F.max(F.greatest("top", "node_id")) + 1).alias("fresh"))
    last = cells.agg(F.max("back")).first()[0] or 0
    cells = cells.drop("top")
    columns = ["run_id", "ord", "cell_id", "genome", "node_id"]
    nodes, first, bottom = None, None, cells.where("back = 0").select(columns)
    for back in range(last + 1):
        upper = cells.where(F.col("back") == back + 1).select(columns)
        more = upper.groupBy("run_id").agg((F.max("ord") + 1).alias("size"))
        ends = bottom.join(large(more), "run_id", "left_anti")
        first = ends if first is None else first.unionByName(ends)
        own = ends.select("run_id", "node_id", "cell_id", F.lit(back).alias("level"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("double").alias("weight"))
        nodes = own if nodes is None else nodes.unionByName(own)
        if back == last:
            break
        bottom = bottom.join(large(more.select("run_id")), "run_id", "left_semi")
        y = bottom.select("run_id", F.col("ord").alias("y_ord"), F.col("cell_id").alias("y_cell"), F.col("genome").alias("y_genome"))
        x = upper.withColumn("copy", F.lit(False)).unionByName(bottom.withColumn("copy", F.lit(True)))
        x = x.select("run_id", "copy", F.col("ord").alias("x_ord"), F.col("cell_id").alias("x_cell"), F.col("genome").alias("x_genome"), F.col("node_id").alias("x_node"))
        pairs = y.join(large(close), ["run_id", "y_cell"]).join(large(x), ["run_id", "x_cell"]).withColumn("same", F.col("x_cell") == F.col("y_cell"))
        pairs = pairs.where("NOT copy OR x_ord < y_ord").where(F.col("same") | ~regains(F.col("x_genome"), F.col("y_genome")))
        pairs = stage(pairs.select("run_id", "y_ord", "copy", "x_ord", "x_node", "same", "dist"), "pairs")
        placed = pairs.where("NOT copy").select("run_id", F.col("y_ord").alias("ord")).distinct()
        copied = leaders(bottom.join(large(placed), ["run_id", "ord"], "left_anti"), pairs.where("copy").select("run_id", F.col("x_ord").alias("a"), F.col("y_ord").alias("b")))
        copied = copied.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")) - 1).join(large(bottom), ["run_id", "ord"]).join(large(more), "run_id").join(large(fresh), "run_id")
        copied = copied.select("run_id", "ord", (F.col("size") + F.col("place")).cast("int").alias("new_ord"), "cell_id", "genome", (F.col("fresh") + F.col("place")).alias("new_id"))
        copied = stage(copied, "copied")
        able = pairs.join(large(copied.select("run_id", F.col("ord").alias("x_ord"), F.lit(True).alias("copy"), "new_id")), ["run_id", "x_ord", "copy"], "left").where("NOT copy OR new_id IS NOT NULL")
        able = able.select("run_id", F.col("y_ord").alias("ord"), "same", "dist", "copy", "x_ord", F.when(F.col("copy"), F.col("new_id")).otherwise(F.col("x_node")).alias("parent_id"))
        best = able.groupBy("run_id", "ord").agg(F.min_by(F.struct("parent_id", F.col("dist").alias("weight")), F.struct(~F.col("same"), F.when(F.col("same"), 0.0).otherwise(F.col("dist")), "copy", "x_ord")).alias("x")).select("run_id", "ord", "x.*")
        best = best.unionByName(copied.select("run_id", "ord", F.col("new_id").alias("parent_id"), F.lit(0.0).alias("weight")))
        nodes = nodes.unionByName(bottom.join(large(best), ["run_id", "ord"]).select("run_id", "node_id", "cell_id", F.lit(back).alias("level"), "parent_id", "weight"))
        bottom = upper.unionByName(copied.select("run_id", F.col("new_ord").alias("ord"), "cell_id", "genome", F.col("new_id").alias("node_id")))
        fresh = fresh.join(large(copied.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))), "run_id", "left").select("run_id", (F.col("fresh") + F.coalesce("n", F.lit(0))).alias("fresh"))
    return stage(nodes, "linked"), stage(first, "earliest"), stage(fresh, "fresh")


def join_earliest(first: DataFrame, distances: DataFrame, fresh: DataFrame) -> DataFrame:
    """(run_id, node_id, parent_id, weight, turn) by neighbour joining of each run's cells (run_id, place, cell_id, node_id) with two at
    least; turn counts new nodes from 0, the root is the last and has no parent. distances (run_id, x_cell, y_cell, dist): all ordered pairs.

    A run's matrix reaches its task as a row for each cell."""
    name = lambda c, p: first.select("run_id", F.col("place").alias(p), F.col("cell_id").alias(c))
    far = distances.join(large(name("x_cell", "a")), ["run_id", "x_cell"]).join(large(name("y_cell", "b")), ["run_id", "y_cell"])
    rows = far.groupBy("run_id", "a").agg(F.array_sort(F.collect_list(F.struct("b", "dist"))).alias("r")).select("run_id", F.col("a").alias("place"), F.col("r.dist").alias("r"))  # a cell's distances
    rows = rows.join(large(first.select("run_id", "place", "node_id")), ["run_id", "place"]).join(large(fresh), "run_id")

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        names = ["run_id", "node_id", "parent_id", "weight", "turn"]
        if len(own) < 2:
            return pd.DataFrame(columns=names)
        joined = neighbour_joining(np.stack(own["r"].to_numpy()), own["node_id"].tolist(), int(own["fresh"].iloc[0]) + 1)
        turn = {node: k for k, node in enumerate(joined.created)}
        run = own["run_id"].iloc[0]
        edges = {(parent, child): weight for parent, child, weight in joined.edges}  # rows of one node may be joined with each other
        found = [(run, child, parent, weight, turn.get(child)) for (parent, child), weight in edges.items()] + [(run, joined.created[-1], None, None, len(turn) - 1)]
        return pd.DataFrame(found, columns=names).astype({"parent_id": "Int64", "weight": "Float64", "turn": "Int64"})

    return rows.groupBy("run_id").applyInPandas(build, "run_id string, node_id long, parent_id long, weight double, turn long")


def assemble(nodes: DataFrame, first: DataFrame, distances: DataFrame, fresh: DataFrame) -> DataFrame:
    """The tree of every run that has two cells in its earliest biopsy, from linked nodes and the distances of that biopsy's cells."""
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")) - 1)
    joined = stage(join_earliest(first, distances, fresh), "joined")
    tops = joined.groupBy("run_id").agg(F.lit(1).alias("one")).select("run_id").join(large(nodes.groupBy("run_id").agg(F.max("level").alias("top"))), "run_id")
    edges = joined.where("turn IS NULL").select("run_id", "node_id", F.col("parent_id").alias("up"), F.col("weight").alias("length"))
    old = nodes.join(large(tops), "run_id").join(large(edges), ["run_id", "node_id"], "left")
    old = old.select("run_id", "node_id", F.coalesce("parent_id", "up").alias("parent_id"), "cell_id", "level", F.coalesce("weight", "length").alias("weight"))
    new = joined.where("turn IS NOT NULL").join(large(tops), "run_id").select("run_id", "node_id", "parent_id", F.lit(None).cast("long").alias("cell_id"), (F.col("top") + 1 + F.col("turn")).alias("level"), "weight")
    return old.unionByName(new).select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in TREE.split(", "))))


def reconstruct(biopsy: DataFrame, distances: DataFrame, radius: float, pooled: bool = False, shared: bool = False) -> DataFrame:
    """The tree of every run: (run_id, node_id, parent_id, cell_id, level, weight). Level 0 is the latest biopsy; joined nodes have no
    cell and a level each; the root is node -1. pooled joins all cells of a run, each once, without layers. A run that comes to one cell in
    its earliest biopsy has no tree and no rows. distances: a matrix of each run. pooled and shared: a cell that was sampled several times is joined as
often but stays one node, so it has a row for each of its parents (``clusters.elements`` counts its labels by paths)."""
    own = biopsy.select(F.col("run_id").cast("string").alias("run_id"), "level", "ord", F.col("cell_id").cast("long").alias("cell_id"), "genome")
    far = distances.select(F.col("run_id").cast("string").alias("run_id"), "i", "j", F.col("id_i").cast("long").alias("id_i"), "dist")
    top = far.groupBy("run_id").agg(F.max("id_i").alias("top"))
    if pooled and shared:
        own = own.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("level", "ord")) - 1).withColumn("node_id", F.col("cell_id"))
        every, own = closest(far, float("inf")), stage(own, "pooled")
        none = [F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("double").alias("weight")]
        return assemble(own.select("run_id", "node_id", "cell_id", *none).distinct(), own, every, top.select("run_id", (F.col("top") + 1).alias("fresh")))
    if pooled:
        own = own.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "cell_id").orderBy("level", "ord"))).where("nth = 1").drop("nth")
        own = own.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("level", "ord")) - 1).withColumn("level", F.lit(0))
    every = closest(far, float("inf"))
    nodes, first, fresh = link(own, stage(every.where(F.col("dist") <= radius), "close"), top)
    return assemble(nodes, first, every, fresh)


def reconstruct_within(biopsy: DataFrame, radius: float) -> DataFrame:
    """The same trees without matrices of whole runs: pairs within the radius come from ``distance.near``, between neighbouring levels and
    inside levels, and only the cells of the earliest biopsy with its copies are measured with each other. biopsy: cell_id names a genome in its run."""
    own = stage(biopsy.select(F.col("run_id").cast("string").alias("run_id"), "level", "ord", F.col("cell_id").cast("long").alias("cell_id"), "genome"), "biopsy")
    cells = stage(own.groupBy("run_id", F.col("cell_id").alias("key")).agg(F.min_by("genome", F.struct("level", "ord")).alias("genome"), F.min("level").alias("level"), F.min_by("ord", F.struct("level", "ord")).alias("ord"), F.count(F.lit(1)).alias("n")), "cells")
    # of both directions the one from the earlier cell counts, as in a matrix; a cell that is sampled again may come under one that it is earlier than
    when = lambda c: cells.select("run_id", F.col("key").alias(c), F.struct("level", "ord").alias(f"{c}_at"))
    profiles, again = cells.select("run_id", "key", "genome"), cells.where("n > 1").select("run_id", "key", "genome")
    ordered = lambda found: found.join(large(when("x")), ["run_id", "x"]).join(large(when("y")), ["run_id", "y"])
    found = ordered(near(profiles, profiles, radius)).where("x_at <= y_at").select("run_id", F.col("x").alias("x_cell"), F.col("y").alias("y_cell"), "dist")
    turned = ordered(near(again, profiles, radius, keep_lost=False)).where("x_at < y_at").select("run_id", F.col("y").alias("x_cell"), F.col("x").alias("y_cell"), "dist")
    found = stage(found.unionByName(turned), "near")
    nodes, first, fresh = link(own, found, own.groupBy("run_id").agg(F.max("cell_id").alias("top")))
    few = first.select("run_id", "cell_id").distinct().join(large(cells.select("run_id", F.col("key").alias("cell_id"), "genome", "level", "ord")), ["run_id", "cell_id"])
    few = stage(few.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("level", "ord")) - 1).alias("ord"), "cell_id", "genome"), "few")
    far = matrix(few)
    return assemble(nodes, first, far.select("run_id", F.col("id_i").alias("x_cell"), F.col("id_j").alias("y_cell"), "dist"), fresh)
