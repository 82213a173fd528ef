"""Clusters of trees: for every node the multiset of labels below it, itself included.

Trees are rows (tree_id, node_id, parent_id, label). Clusters grow by doubling jumps: what lies less than 2k levels below a node is what lies
less than k below it, and the same of its descendants k levels down. So a tree of depth d takes log2(d) joins, and equal labels are one row with
a count from the first step on. (``closure`` keeps pairs of node and ancestor, for layouts.) A node may have several parents, a row each: its labels
then count once for each path. Which clusters are equal is settled by their elements (``alike``), from aggregates of labels: no list is
gathered for it, however large a root's cluster is, and hashes only make the first guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.functions.staging import stage

#: What ``alike`` names a cluster by.
MARK = ["h1", "h2", "size", "fix"]


def closure(nodes: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(tree_id, node_id, anc): every node with itself and each of its ancestors."""
    pairs = nodes.select("tree_id", "node_id", F.col("node_id").alias("anc"))
    jump = stage(nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("node_id").alias("anc"), F.col("parent_id").alias("up")), "jump")
    for _ in range(max_doublings):
        if jump.isEmpty():
            return pairs
        pairs = stage(pairs.unionByName(pairs.join(jump, ["tree_id", "anc"]).select("tree_id", "node_id", F.col("up").alias("anc"))), "pairs")
        further = jump.withColumnRenamed("anc", "low").withColumnRenamed("up", "anc").join(jump, ["tree_id", "anc"])
        jump = stage(further.select("tree_id", F.col("low").alias("anc"), "up"), "jump")
    raise ValueError("the trees have a cycle, or are deeper than any tree is")


def within(nodes: DataFrame, roots: DataFrame, max_doublings: int = 40) -> DataFrame:
    """The nodes at and below the roots (tree_id, root); a root has no parent then. Pointers jump to the top of what is above them."""
    cut = nodes.join(roots, "tree_id").withColumn("parent_id", F.when(F.col("node_id") != F.col("root"), F.col("parent_id")))
    cut = stage(cut, "cut")
    tops = stage(cut.select("tree_id", "node_id", F.coalesce("parent_id", "node_id").alias("top")), "tops")
    for _ in range(max_doublings):
        above = tops.select("tree_id", F.col("node_id").alias("top"), F.col("top").alias("next"))
        moved = stage(tops.join(above, ["tree_id", "top"], "left").select("tree_id", "node_id", "top", F.coalesce("next", "top").alias("next")), "tops")
        tops = moved.select("tree_id", "node_id", F.col("next").alias("top"))
        if moved.where("next <> top").isEmpty():
            return cut.join(tops, ["tree_id", "node_id"]).where("top = root").drop("top", "root")
    raise ValueError("the trees have a cycle, or are deeper than any tree is")


def elements(nodes: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(tree_id, anc, label, cnt): the clusters' elements; nodes without a label add nothing. A label below a node counts once for each path
    that leads to it, so once in a tree; repeated rows count once."""
    rows = nodes.where("label IS NOT NULL").select("tree_id", F.col("node_id").alias("anc"), "label").distinct().withColumn("cnt", F.lit(1).cast("long"))
    edges = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("node_id").alias("anc"), F.col("parent_id").alias("up")).distinct()
    jump = stage(edges.withColumn("ways", F.lit(1).cast("long")), "jump")
    for _ in range(max_doublings):
        if jump.isEmpty():
            return rows
        moved = rows.join(jump, ["tree_id", "anc"]).select("tree_id", F.col("up").alias("anc"), "label", (F.col("cnt") * F.col("ways")).alias("cnt"))
        rows = stage(rows.unionByName(moved).groupBy("tree_id", "anc", "label").agg(F.sum("cnt").alias("cnt")), "elements")
        lower = jump.select("tree_id", F.col("anc").alias("low"), F.col("up").alias("anc"), F.col("ways").alias("first"))
        further = lower.join(jump, ["tree_id", "anc"]).groupBy("tree_id", "low", "up").agg(F.sum(F.col("first") * F.col("ways")).alias("ways"))
        jump = stage(further.select("tree_id", F.col("low").alias("anc"), "up", "ways"), "jump")
    raise ValueError("the trees have a cycle, or are deeper than any tree is")


def identity():
    """Aggregates that guess which clusters of elements (label, cnt) are equal: h1, h2 and size."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "label", "cnt").cast("decimal(20,0)"))
    zero = F.lit(0).cast("decimal(30,0)")
    return [F.coalesce(part(1), zero).alias("h1"), F.coalesce(part(2), zero).alias("h2"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("size")]


def alike(members: DataFrame, elements: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """members (scope, key), a row a cluster, with the columns of MARK: two of one scope bear the same exactly where their elements (scope, key,
    label, cnt) are the same. A cluster without elements has size 0.

    Clusters start in the groups that ``identity`` guesses. A group is right if each of its labels is in all its clusters, with one count; one that isn't is
    parted by the counts of its least label that differs, until all are right. Both are sums by group and label, combined
    before they are shuffled, so neither a group with a third of all clusters nor a cluster with all labels is gathered."""
    on = [*scope, *key]
    guess = elements.groupBy(*on).agg(*identity())
    none = {c: F.coalesce(c, F.lit(0).cast(guess.schema[c].dataType)) for c in MARK[:3]}
    marked = members.join(guess, on, "left").withColumns(none).withColumn("fix", F.array().cast("array<bigint>"))
    while True:
        marked = stage(marked, "marked")
        groups = marked.groupBy(*scope, *MARK).agg(F.count(F.lit(1)).alias("clusters"))
        labels = elements.join(marked.select(*on, *MARK), on).groupBy(*scope, *MARK, "label").agg(F.count(F.lit(1)).alias("holders"), F.min("cnt").alias("least"), F.max("cnt").alias("most"))
        mixed = labels.join(groups, [*scope, *MARK]).where("holders < clusters OR least < most").groupBy(*scope, *MARK).agg(F.min("label").alias("by"))
        if mixed.isEmpty():
            return marked
        mixed = stage(mixed, "mixed")
        own = elements.select(*on, F.col("label").alias("by"), "cnt")
        parted = marked.join(mixed, [*scope, *MARK], "left").join(own, [*on, "by"], "left")
        marked = parted.withColumn("fix", F.when(F.col("by").isNull(), F.col("fix")).otherwise(F.concat("fix", F.array(F.coalesce("cnt", F.lit(0).cast("long")))))).drop("by", "cnt")


def numbered(nodes: DataFrame) -> DataFrame:
    """(tree_id, anc, first_tree, first_node, n): the least node, over all trees, that has the same cluster, and how many have it."""
    every = elements(nodes).withColumn("scope", F.lit(0))
    members = nodes.select(F.lit(0).alias("scope"), "tree_id", F.col("node_id").alias("anc")).distinct()
    marked = alike(members, every, ["scope"], ["tree_id", "anc"])
    groups = marked.groupBy(*MARK).agg(F.min(F.struct("tree_id", "anc")).alias("first"), F.count(F.lit(1)).alias("n"))
    return marked.join(groups, MARK).select("tree_id", "anc", F.col("first.tree_id").alias("first_tree"), F.col("first.anc").alias("first_node"), "n")


def signatures(rows: DataFrame) -> DataFrame:
    """(tree_id, anc, signature): elements (tree_id, anc, label, cnt) as one text a cluster, label=cnt joined by bars; bars, equals
    signs and backslashes of labels are escaped. For reading and tests: a signature is as long as its cluster."""
    safe = F.regexp_replace("label", r"([\\|=])", r"\\$1")
    return rows.groupBy("tree_id", "anc").agg(F.array_join(F.array_sort(F.collect_list(F.concat(safe, F.lit("="), F.col("cnt").cast("string")))), "|").alias("signature"))


def leaf_and_inner_labels(nodes: DataFrame) -> DataFrame:
    """(tree_id, label, is_leaf): distinct labels of leaves and of inner nodes."""
    parents = nodes.where("parent_id IS NOT NULL").select("tree_id", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    rows = nodes.where("label IS NOT NULL").join(parents, ["tree_id", "node_id"], "left")
    return rows.select("tree_id", "label", F.col("inner").isNull().alias("is_leaf")).distinct()
