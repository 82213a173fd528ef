"""Similarity of trees by their clusters (generalised Robinson-Foulds), for many pairs of trees at once.

With lists A and B of clusters (one a node), U different clusters in both, and the Jaccard distance J of multisets:
    1 - [ sum over a in A, b in B not in A, of J(a, b) / (|A| U) + sum over b in B, a in A not in B, of J(b, a) / (|B| U) ].
J is 1 for clusters that share no label, so both sums are counted at once and then lowered by the pairs that do share one. Those
come from an equi-join on the label, between representatives of different clusters. A label that is in many clusters of both trees makes as many
pairs as the clusters it is in; those of a label above ``PAIRS`` are dealt to several tasks, and combined before they are shuffled. Where nearly every
cluster meets nearly every other (long chains, one label everywhere), ``by_blocks`` works through squares of clusters instead, and no pair is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.functions.staging import stage
from phylospark.operators import clusters

KEY = clusters.MARK
#: Pairs of clusters that one task makes of a label, about.
PAIRS = 2_000_000
#: Frequent labels that are sent to every task at most.
MAX_OFTEN = 100_000
#: Clusters of a side in a block, about; a square of two blocks is one matrix of a task.
BLOCK = 2048
#: Labels of a cluster in blocks, on average; and of the largest one.
MEAN_LABELS, MOST_LABELS = 64, 1_000_000


def sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (tree_id, ...) under (pair_id, side): side 0 is left_tree, 1 is right_tree."""
    each = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_tree").alias("tree_id")), F.struct(F.lit(1).alias("side"), F.col("right_tree").alias("tree_id")))).alias("s"))
    return rows.join(each.select("pair_id", "s.side", "s.tree_id"), "tree_id").drop("tree_id")


def score(members: DataFrame, elements: DataFrame, as_sets: bool = False) -> DataFrame:
    """(pair_id, similarity, n_left, n_right, n_union). members: (pair_id, side, anc), a row a cluster; elements: (pair_id, side, anc,
    label, cnt). as_sets counts a cluster of a side once and leaves empty ones out, with 0 where a side has none."""
    named = clusters.alike(members, elements, ["pair_id"], ["side", "anc"])
    count = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    kinds = named.groupBy("pair_id", *KEY).agg(count(0).alias("ma"), count(1).alias("mb"), F.min(F.when(F.col("side") == 0, F.col("anc"))).alias("rep_a"), F.min(F.when(F.col("side") == 1, F.col("anc"))).alias("rep_b"))
    if as_sets:
        kinds = kinds.withColumns({"ma": F.least("ma", F.lit(1)), "mb": F.least("mb", F.lit(1))})
    kinds = stage(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    counted = F.col("size") > 0 if as_sets else F.lit(True)
    of = lambda c: F.sum(F.when(counted, c).otherwise(0))
    totals = kinds.groupBy("pair_id").agg(of(F.col("ma")).alias("na"), of(F.col("mb")).alias("nb"), F.count(F.lit(1)).alias("u"), of(F.when(F.col("ma") == 0, F.col("mb")).otherwise(0)).alias("only_b"), of(F.when(F.col("mb") == 0, F.col("ma")).otherwise(0)).alias("only_a"))

    def side(s: int, own: str) -> DataFrame:
        rep = kinds.where(f"{own} IS NOT NULL").select("pair_id", F.col(own).alias("anc"), "kind", "ma", "mb", "size")
        return elements.where(F.col("side") == s).join(rep, ["pair_id", "anc"]).select("pair_id", "label", *(F.col(c).alias(f"{c}_{s}") for c in ("cnt", "kind", "ma", "mb", "size")))

    left, right = side(0, "rep_a"), side(1, "rep_b")
    square = dense(left, right, kinds)
    if square is None:
        less = by_pairs(left, right, kinds)
    else:
        rest = lambda rows: rows.join(square, "pair_id", "left_anti")
        less = by_pairs(rest(left), rest(right), rest(kinds)).unionByName(by_blocks(left.join(square, "pair_id"), right.join(square, "pair_id")))
    less = less.groupBy("pair_id").agg(F.sum("less_1").alias("less_1"), F.sum("less_2").alias("less_2"))
    rows = totals.join(less, "pair_id", "left").fillna(0.0, ["less_1", "less_2"])
    first = (F.col("na") * F.col("only_b") - F.col("less_1")) / (F.col("na") * F.col("u"))
    second = (F.col("nb") * F.col("only_a") - F.col("less_2")) / (F.col("nb") * F.col("u"))
    value = F.when((F.col("na") > 0) & (F.col("nb") > 0) & (F.col("u") > 0), 1 - (first + second)).otherwise(0.0)
    return rows.select("pair_id", value.alias("similarity"), F.col("na").alias("n_left"), F.col("nb").alias("n_right"), F.col("u").alias("n_union"))


def by_pairs(left: DataFrame, right: DataFrame, kinds: DataFrame) -> DataFrame:
    """(pair_id, less_1, less_2): what pairs that share a label take from either sum, a row a pair of clusters in between."""
    both = by_label(left, right, kinds).where("kind_0 <> kind_1 AND (ma_1 = 0 OR mb_0 = 0)")
    shared = both.groupBy("pair_id", "kind_0", "kind_1", "ma_0", "mb_0", "ma_1", "mb_1", "size_0", "size_1").agg(F.sum(F.least("cnt_0", "cnt_1")).alias("i"))
    overlap = F.col("ma_0") * F.col("mb_1") * F.col("i") / (F.col("size_0") + F.col("size_1") - F.col("i"))
    return shared.groupBy("pair_id").agg(F.sum(F.when(F.col("ma_1") == 0, overlap).otherwise(0.0)).alias("less_1"), F.sum(F.when(F.col("mb_0") == 0, overlap).otherwise(0.0)).alias("less_2"))


def dense(left: DataFrame, right: DataFrame, kinds: DataFrame) -> DataFrame | None:
    """(pair_id, blocks_0, blocks_1) of the pairs of trees that squares of clusters suit, None where there is none: a join would make over PAIRS rows,
    four times as many as blocks hold, and clusters have few labels, so that a block fits a task."""
    most = kinds.groupBy("pair_id").agg((F.count("rep_a") * F.count("rep_b")).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= PAIRS:  # a label is in each cluster once, so few labels would have to be frequent for more
        return None
    count = lambda rows, name: rows.groupBy("pair_id", "label").agg(F.count(F.lit(1)).alias(name))
    joined = count(left, "a").join(count(right, "b"), ["pair_id", "label"]).groupBy("pair_id").agg(F.sum(F.col("a") * F.col("b")).alias("joined"))
    large = lambda rows, s: rows.groupBy("pair_id", f"kind_{s}").agg(F.count(F.lit(1)).alias("n")).groupBy("pair_id").agg(F.sum("n").alias(f"rows_{s}"), F.count(F.lit(1)).alias(f"kinds_{s}"), F.max("n").alias(f"most_{s}"))
    rows = joined.join(large(left, 0), "pair_id").join(large(right, 1), "pair_id").withColumns({f"blocks_{s}": F.ceil(F.col(f"kinds_{s}") / BLOCK).cast("int") for s in (0, 1)})
    fits = lambda s: f"rows_{s} <= {MEAN_LABELS} * kinds_{s} AND most_{s} <= {MOST_LABELS}"
    found = rows.where(f"joined > {PAIRS} AND joined > 4 * (rows_0 * blocks_1 + rows_1 * blocks_0)").where(fits(0)).where(fits(1))
    found = stage(found.select("pair_id", "blocks_0", "blocks_1"), "dense")
    return None if found.isEmpty() else found


def square_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """``by_pairs`` of the clusters of two blocks, from one matrix of their intersections."""
    if left.empty or right.empty:
        return pd.DataFrame({"pair_id": [], "less_1": [], "less_2": []})
    at, firsts = [], []
    for own, s in ((left, 0), (right, 1)):
        _, first, places = np.unique(own[f"kind_{s}"].to_numpy(), return_index=True, return_inverse=True)
        at.append(places)
        firsts.append(own.iloc[first])
    shared = np.zeros((len(firsts[0]), len(firsts[1])))
    there = right.groupby("label", sort=False).indices
    for label, i in left.groupby("label", sort=False).indices.items():
        j = there.get(label)
        if j is not None:  # a cluster has a label once, so places in i, and in j, differ
            shared[np.ix_(at[0][i], at[1][j])] += np.minimum.outer(left["cnt_0"].to_numpy()[i], right["cnt_1"].to_numpy()[j])
    a, b = firsts
    size = a["size_0"].to_numpy(float)[:, None] + b["size_1"].to_numpy(float)[None, :]
    overlap = shared / (size - shared) * a["ma_0"].to_numpy(float)[:, None] * b["mb_1"].to_numpy(float)[None, :]
    return pd.DataFrame({"pair_id": [left["pair_id"].iloc[0]], "less_1": [overlap[:, b["ma_1"].to_numpy() == 0].sum()], "less_2": [overlap[a["mb_0"].to_numpy() == 0].sum()]})


def by_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """``by_pairs``, a square of two blocks a group: rows are as many as elements times blocks of the other side, and only sums leave a task."""
    own = lambda s: F.pmod(F.xxhash64(f"kind_{s}"), F.col(f"blocks_{s}")).cast("int")
    all_of = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{s}") - 1))
    of = lambda rows, s: rows.select(*(F.col(c).alias(c) for c in ("pair_id", "label", *(f"{c}_{s}" for c in ("cnt", "kind", "ma", "mb", "size")), "x", "y")))
    keys = ["pair_id", "x", "y"]
    left = of(left.withColumn("x", own(0)).withColumn("y", all_of(1)), 0).groupBy(*keys)
    right = of(right.withColumn("y", own(1)).withColumn("x", all_of(0)), 1).groupBy(*keys)
    return left.cogroup(right).applyInPandas(square_sums, "pair_id string, less_1 double, less_2 double")


def by_label(left: DataFrame, right: DataFrame, kinds: DataFrame) -> DataFrame:
    """The clusters of both sides that share a label: left rows of a frequent label are dealt, right ones go to each part."""
    on = ["pair_id", "label"]
    most = kinds.groupBy("pair_id").agg((F.count("rep_a") * F.count("rep_b")).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= PAIRS:  # then no label makes more
        return left.join(right, on)
    count = lambda rows, name: rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    often = count(left, "a").join(count(right, "b"), on).withColumn("parts", F.ceil(F.col("a") * F.col("b") / PAIRS).cast("int")).where("parts > 1").select(*on, "parts")
    often = stage(often, "often")
    if often.isEmpty():
        return left.join(right, on)
    if often.count() <= MAX_OFTEN:  # else a shuffle, which adaptive execution splits
        often = F.broadcast(often)
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(often, on, "left").withColumn("part", F.pmod(F.xxhash64("kind_0"), parts).cast("int")).drop("parts")
    right = right.join(often, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*on, "part"])


def prepared(nodes: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes of trees, below the roots if given, their clusters (tree_id, anc) and elements."""
    nodes = stage(nodes if roots is None else clusters.within(nodes, roots), "nodes")
    return nodes, nodes.select("tree_id", F.col("node_id").alias("anc")).distinct(), clusters.elements(nodes)


def similarity(nodes: DataFrame, pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Over all labels. nodes: (tree_id, node_id, parent_id, label); pairs: (pair_id, left_tree, right_tree); roots: (tree_id, root)."""
    _, members, elements = prepared(nodes, roots)
    return score(sides(members, pairs), sides(elements, pairs))


def shared_label_similarity(nodes: DataFrame, pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Restricted to labels of leaves of either tree and of inner nodes of both."""
    nodes, members, elements = prepared(nodes, roots)
    labels = sides(clusters.leaf_and_inner_labels(nodes), pairs)
    allowed = labels.where("is_leaf").select("pair_id", "label").union(labels.where("NOT is_leaf").groupBy("pair_id", "label").agg(F.countDistinct("side").alias("n")).where("n = 2").select("pair_id", "label")).distinct()
    return score(sides(members, pairs), sides(elements, pairs).join(allowed, ["pair_id", "label"], "left_semi"))


def given_label_similarity(nodes: DataFrame, pairs: DataFrame, allowed: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Restricted to the labels of allowed (label), over sets of clusters that aren't empty."""
    _, members, elements = prepared(nodes, roots)
    return score(sides(members, pairs), sides(elements.join(allowed.select("label").distinct(), "label", "left_semi"), pairs), as_sets=True)
