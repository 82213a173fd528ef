"""Branching evolution: every generation is one DataFrame step for all runs at once.

A cell of generation g-1 has its drawn number of offspring plus one. Each child draws events locus by locus, applies them in order,
dies if a crucial locus is lost, and is left out if an earlier child of its generation has the same genome. All draws are hashes
of their coordinates, so steps can be retried and repartitioned freely. Each generation is written to the shared folder before the
next one starts. Children are numbered densely within a run by offsets of buckets of parents; no run is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.functions.rng import poisson, uniform, uniform_int
from phylospark.functions.staging import stage
from phylospark.sources.config import Model
from phylospark.sources.loci import MAX_LOCI

PARENTS_IN_BUCKET = 4096
NODES = ["run_id", "node_id", "parent_id", "generation", "cell_id", "genome", "events"]


@dataclass(frozen=True)
class Genome:
    """The resolved loci as literals."""

    cn: list[int]
    p_event: list[float]
    multiple: list[float]
    duplication: list[float]
    multiplicity: list[float]
    weight: list[float]
    crucial: list[bool]
    last: list[int] | None = None  # the last locus of each one's chromosome

    @classmethod
    def of(cls, loci: DataFrame) -> Genome:
        """From ``loci.resolve``; a genome has at most MAX_LOCI loci."""
        rows = loci.orderBy("pos").limit(MAX_LOCI + 1).collect()
        if len(rows) > MAX_LOCI:
            raise ValueError(f"a genome has more than {MAX_LOCI} loci")
        get = lambda name, kind: [kind(r[name]) for r in rows]
        last, following = [], len(rows) - 1
        for i in range(len(rows) - 1, -1, -1):  # a chromosome is a run of loci
            following = i if i == len(rows) - 1 or rows[i]["chromosome"] != rows[i + 1]["chromosome"] else following
            last.append(following)
        return cls(get("cn", int), get("p_event", float), get("multiple_prob", float), get("duplication_prob", float), get("duplication_multiplicity", float), get("fitness_weight", float), get("crucial", bool), last[::-1])


def offspring(model: Model, u: Column, genome: Column, weights: Column) -> Column:
    """The drawn number of offspring, before the one that is added."""
    p = model.offspring_parameter
    if model.offspring == "constant":
        return F.lit(int(float(p)))
    if model.offspring == "uniform_range":
        low, high = map(int, p.split(","))
        return uniform_int(u, low, high)
    if model.offspring == "poisson":
        return poisson(u, float(p))
    return poisson(u, profiles.fitness_mean(genome, weights, float(p)))


def draw_events(model: Model, loci: Genome, *coordinates) -> Column:
    """The events of a child in order of their first locus."""
    n = len(loci.cn)
    u = lambda i, name: uniform(*coordinates, i, F.lit(name))
    at = lambda values, i: F.get(F.lit(values), i)
    multiple = (lambda i: at(loci.multiple, i)) if model.locus_overrides else (lambda i: F.lit(model.multiple_prob))
    duplicated = (lambda i: at(loci.duplication, i)) if model.locus_overrides else (lambda i: F.lit(model.duplication_prob))
    mean = (lambda i: at(loci.multiplicity, i)) if model.locus_overrides else (lambda i: F.lit(model.duplication_multiplicity))

    def event(i: Column) -> Column:
        end = F.when(u(i, "multiple") < multiple(i), uniform_int(u(i, "end"), i, at(loci.last, i) if model.clip_chromosomes else n - 1)).otherwise(i)
        gain = u(i, "type") < duplicated(i)
        copies = F.when(gain, poisson(u(i, "copies"), mean(i)) + 1).otherwise(-1)
        return F.struct(i.alias("pos_start"), end.cast("int").alias("pos_end"), F.when(gain, "duplication").otherwise("loss").alias("type"), copies.cast("int").alias("copies"))

    hit = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: u(i, "event") < at(loci.p_event, i))
    return F.transform(hit, event)


def founders(runs: DataFrame, loci: Genome) -> DataFrame:
    """One cell a run (run_id, seed, ...): node 0 of generation 0."""
    zero = F.lit(0).cast("long")
    return runs.select("run_id", "seed", zero.alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("generation"), zero.alias("cell_id"), F.lit(loci.cn).cast("array<int>").alias("genome"), F.array().cast(profiles.EVENTS).alias("events"))


def children(parents: DataFrame, model: Model, loci: Genome, generation: int) -> DataFrame:
    """All children that live, not yet numbered: (run_id, seed, parent_id, parent_cell, child, genome, events)."""
    draws = ["seed", "run_id", F.lit(generation), "node_id"]
    named = [F.col(c) if isinstance(c, str) else c for c in draws]
    k = offspring(model, uniform(*named, F.lit("offspring")), F.col("genome"), F.lit(loci.weight))
    born = parents.select("run_id", "seed", "node_id", F.col("cell_id").alias("parent_cell"), F.col("genome").alias("parent_genome"), F.explode(F.sequence(F.lit(0), k)).alias("child"))
    born = born.withColumn("events", draw_events(model, loci, *named, F.col("child")))
    done = profiles.apply_events(F.col("parent_genome"), F.col("events"), F.lit(loci.crucial) if model.crucial else None, model.crucial_everywhere, model.absorbing_zero)
    born = born.withColumn("done", done).where("NOT done.dead")
    return born.select("run_id", "seed", F.col("node_id").alias("parent_id"), "parent_cell", "child", F.col("done.genome").alias("genome"), "events")


def first_of_each_genome(born: DataFrame) -> DataFrame:
    """Of children of a run with the same genome the first by parent and child; counts are combined before they are shuffled."""
    rest = [c for c in born.columns if c not in ("run_id", "genome")]
    first = born.groupBy("run_id", "genome").agg(F.min_by(F.struct(*rest), F.struct("parent_id", "child")).alias("first"))
    return first.select("run_id", "genome", "first.*")


def number(born: DataFrame, next_ids: DataFrame) -> DataFrame:
    """Adds node_id: dense within a run, by parent and child, from next_ids (run_id, next_id) on."""
    rows = born.withColumn("bucket", F.floor(F.col("parent_id") / PARENTS_IN_BUCKET))
    before = Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.join(next_ids, "run_id").select("run_id", "bucket", (F.col("ahead") + F.col("next_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("run_id", "bucket").orderBy("parent_id", "child")) - 1
    return rows.withColumn("place", place).join(offsets, ["run_id", "bucket"]).withColumn("node_id", F.col("first") + F.col("place")).drop("bucket", "first", "place")


def next_generation(parents: DataFrame, next_ids: DataFrame, model: Model, loci: Genome, generation: int) -> DataFrame:
    born = children(parents, model, loci, generation)
    if model.representative:
        born = first_of_each_genome(born)
    cell = F.when(F.size("events") > 0, F.col("node_id")).otherwise(F.col("parent_cell"))
    return number(born, next_ids).select("run_id", "seed", "node_id", "parent_id", F.lit(generation).alias("generation"), cell.alias("cell_id"), "genome", "events")


def simulate(runs: DataFrame, loci: DataFrame, model: Model) -> DataFrame:
    """All cells of all runs (run_id, seed); loci as ``loci.resolve`` returns them."""
    genome = Genome.of(loci)
    current = stage(founders(runs, genome), "generation")
    everything, next_ids = current, runs.select("run_id", F.lit(1).cast("long").alias("next_id"))
    for generation in range(1, model.generations + 1):
        current = stage(next_generation(current, next_ids, model, genome, generation), "generation")
        next_ids = stage(next_ids.join(current.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id", "left").select("run_id", (F.col("next_id") + F.coalesce("n", F.lit(0))).alias("next_id")), "next")
        everything = everything.unionByName(current)
    return everything.select(*NODES)


def edges(nodes: DataFrame) -> DataFrame:
    """(run_id, parent_id, child_id, events): events as the rendered text, empty where a child equals its parent."""
    return nodes.where("parent_id IS NOT NULL").select("run_id", "parent_id", F.col("node_id").alias("child_id"), profiles.render_events(F.col("events")).alias("events"))
