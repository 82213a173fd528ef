"""The whole experiment over many runs: simulate, sample, measure, reconstruct and score; and the same from files to files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.functions.staging import stage
from phylospark.operators import biopsy as sampling
from phylospark.operators import distance, evolve, linking
from phylospark.operators.similarity import similarity
from phylospark.operators.timing import Timings
from phylospark.sources import config, loci, profiles
from phylospark.sources.config import Model

KINDS = ("layered", "pooled")
FEW_CELLS, ONE_CELL = "fewer than three sampled cells", "one cell in the earliest biopsy"


@dataclass
class Tables:
    """What an experiment leaves, each staged: all cells, sampled cells of runs with enough, their distances, the trees of all kinds, and a result a run."""

    nodes: DataFrame
    biopsy: DataFrame
    distances: DataFrame
    trees: DataFrame
    results: DataFrame


def as_trees(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of runs as trees (tree_id, node_id, parent_id, label); a node's label is its cell."""
    return nodes.select(F.concat_ws("/", "run_id", F.lit(kind)).alias("tree_id"), "node_id", "parent_id", F.col("cell_id").cast("string").alias("label"))


def run_tables(runs: DataFrame, resolved: DataFrame, model: Model, generations: list[int], size: int | None = None, fraction: float | None = None, radius: float = 4, seed: int = 0, timings: Timings | None = None) -> Tables:
    """Runs (run_id, seed) from the founder to the scores. Every run has a result (run_id, n_nodes, n_cells, similarity_layered,
    similarity_pooled, n_inexact, reason); one that can't be scored has no similarities but a reason. n_inexact counts the pairs of sampled cells
whose distance is an upper bound only, so that links may hang on one.

    The simulated tree is compared whole, from its founder; reconstructed ones from their root. Genomes are needed up to the
    distances only; later steps don't read them."""
    timings = timings or Timings()
    with timings("simulation"):
        nodes = stage(evolve.simulate(runs, resolved, model), "nodes")
        biopsy = stage(sampling.sample(nodes, generations, size, fraction, seed), "sample")
        cells = stage(biopsy.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("n_first")), "cells")
        biopsy = stage(biopsy.join(sampling.large_enough(biopsy).select("run_id"), "run_id", "left_semi"), "biopsy")
    with timings("distances"):
        distances = stage(distance.matrix(sampling.pooled(biopsy)), "distances")
    with timings("reconstruction"):
        # a run whose earliest biopsy has one cell can't be joined; such runs have no tree of either kind
        joinable = cells.where("n_cells >= 3 AND n_first > 1").select("run_id")
        own, far = biopsy.join(joinable, "run_id", "left_semi"), distances.join(joinable, "run_id", "left_semi")
        layered = linking.reconstruct(own, far, radius)
        joined = linking.reconstruct(sampling.pooled(own), far, radius, pooled=True)
        trees = stage(as_trees(nodes, "true").unionByName(as_trees(layered, "layered")).unionByName(as_trees(joined, "pooled")), "trees")
    with timings("similarity"):
        name = lambda kind: F.concat_ws("/", "run_id", F.lit(kind))
        pairs = joinable.select(F.explode(F.array(*(F.struct(name(k).alias("pair_id"), name("true").alias("left_tree"), name(k).alias("right_tree")) for k in KINDS))).alias("p")).select("p.*")
        roots = trees.select("tree_id").distinct().select("tree_id", F.when(F.col("tree_id").endswith("/true"), 0).otherwise(-1).cast("long").alias("root"))
        scores = similarity(trees, pairs, roots).withColumn("kind", F.substring_index("pair_id", "/", -1))
        scores = scores.withColumn("run_id", F.expr("left(pair_id, length(pair_id) - length(kind) - 1)"))
        pivot = scores.groupBy("run_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("similarity"))).alias(f"similarity_{k}") for k in KINDS))
        sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_nodes"))
        counted = cells.withColumnRenamed("n_first", "first")
        every = runs.select("run_id").distinct().join(sizes, "run_id", "left").join(counted, "run_id", "left").join(pivot, "run_id", "left")
        every = every.join(distances.where("NOT exact AND i < j").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_inexact")), "run_id", "left")
        few = F.coalesce("n_cells", F.lit(0)) < 3
        reason = F.when(few, FEW_CELLS).when(F.col("first") < 2, ONE_CELL)
        results = every.select("run_id", "n_nodes", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), *(f"similarity_{k}" for k in KINDS), F.coalesce("n_inexact", F.lit(0)).alias("n_inexact"), reason.alias("reason"))
        return Tables(nodes, biopsy, distances, trees, stage(results, "results"))


def run_experiment(runs: DataFrame, resolved: DataFrame, model: Model, generations: list[int], size: int | None = None, fraction: float | None = None, radius: float = 4, seed: int = 0, timings: Timings | None = None) -> DataFrame:
    """The results of ``run_tables``."""
    return run_tables(runs, resolved, model, generations, size, fraction, radius, seed, timings).results


def summary(tables: Tables) -> DataFrame:
    """(run_id, item, value): sampled cells of each biopsy and in all, and the nodes of each tree of every run that has them."""
    levels = tables.biopsy.groupBy("run_id", F.concat(F.lit("biopsy_"), "level").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    every = tables.biopsy.groupBy("run_id", F.lit("biopsies").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    kind = F.substring_index("tree_id", "/", -1)
    sizes = tables.trees.groupBy(F.expr("left(tree_id, length(tree_id) - length(substring_index(tree_id, '/', -1)) - 1)").alias("run_id"), F.concat(F.lit("tree_"), kind).alias("item")).agg(F.count(F.lit(1)).alias("value"))
    return levels.unionByName(every).unionByName(sizes)


def run_files(spark: SparkSession, model_file: str, out: str, generations: list[int], locus_file: str | None = None, size: int | None = None, fraction: float | None = None, radius: float = 4, seed: int = 0) -> DataFrame:
    """One run from a configuration (and a table of loci) to files below out: the parameters as they are in effect, the sampled profiles of each
    biopsy, the matrix of distances, the edges of every tree, the counts of ``summary`` and a line of results, which is returned too."""
    model = config.read_model(spark, model_file)
    table = loci.read_loci(spark, locus_file) if locus_file else loci.constant_loci(spark, model)
    resolved = stage(loci.resolve(table, model), "loci")
    loci.write_resolved(resolved, f"{out}/parameters", model.telomeres)
    loci.write_bed_like(resolved, f"{out}/loci")
    runs = spark.createDataFrame([("run", seed)], "run_id string, seed long")
    tables = run_tables(runs, resolved, model, generations, size, fraction, radius, seed)
    for level in range(len(generations)):
        profiles.write_profiles(tables.biopsy.where(F.col("level") == level), f"{out}/biopsy_{level}")
    profiles.write_matrix(tables.distances, f"{out}/distances")
    tables.trees.where("parent_id IS NOT NULL").select(F.substring_index("tree_id", "/", -1).alias("tree"), "parent_id", "node_id", "label").coalesce(1).write.mode("overwrite").csv(f"{out}/edges", header=True)
    summary(tables).drop("run_id").coalesce(1).orderBy("item").write.mode("overwrite").csv(f"{out}/summary", header=True)  # a row a biopsy and tree
    share = size if size is not None else fraction
    line = F.format_string("{'GenTreeSize': %d, 'TreeSize': %d, 'NumBiopsies': %d, 'biopsy_size': %s, 'RPercentile': %s, 'Result': %s}", F.col("n_nodes"), F.lit(model.generations), F.lit(len(generations)), F.lit(str(float(share))), F.lit(str(radius)), F.coalesce(F.col("similarity_layered").cast("string"), F.lit("null")))
    tables.results.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/results")
    return tables.results
