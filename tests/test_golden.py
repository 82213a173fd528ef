"""Results known from elsewhere, and options beyond the defaults."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.functions.rng import poisson
from phylospark.operators import distance, evolve, linking
from phylospark.plans.reconstruction_queries import MODEL
from phylospark.sources import loci
from phylospark.sources.profiles import profile_lines, read_matrix, read_profiles, write_matrix, write_profiles
from tests.test_evolution import events, one

# Twenty sampled cells with their profiles, biopsy by biopsy.
CELLS = [
    [
        (8, [2, 3, 2, 2, 2, 4, 2, 2, 2, 2]),
        (6, [2, 2, 2, 3, 2, 2, 2, 2, 2, 2]),
    ],
    [
        (30, [4, 2, 2, 3, 2, 2, 2, 2, 2, 2]),
        (25, [2, 2, 2, 2, 2, 2, 2, 2, 2, 1]),
        (21, [6, 3, 2, 2, 2, 2, 2, 2, 4, 7]),
        (22, [6, 3, 4, 2, 2, 2, 2, 2, 2, 6]),
        (16, [2, 2, 2, 2, 2, 2, 2, 2, 2, 0]),
        (20, [6, 3, 2, 1, 2, 2, 2, 2, 2, 1]),
    ],
    [
        (50, [2, 3, 2, 1, 2, 2, 2, 2, 2, 2]),
        (48, [4, 2, 2, 3, 2, 3, 2, 2, 2, 2]),
        (56, [8, 3, 4, 1, 2, 2, 2, 2, 2, 1]),
        (38, [5, 3, 4, 2, 2, 2, 2, 2, 2, 6]),
        (65, [6, 2, 2, 2, 2, 2, 2, 2, 2, 0]),
        (21, [6, 3, 2, 2, 2, 2, 2, 2, 4, 7]),
        (71, [1, 2, 2, 3, 2, 2, 5, 2, 2, 2]),
        (32, [1, 3, 2, 1, 2, 2, 2, 2, 2, 1]),
        (57, [6, 3, 2, 1, 1, 2, 2, 2, 2, 0]),
        (43, [2, 2, 2, 2, 2, 2, 2, 1, 2, 1]),
        (54, [6, 3, 4, 1, 2, 2, 2, 2, 2, 0]),
        (34, [6, 3, 4, 1, 2, 2, 2, 2, 2, 1]),
    ],
]
# Their known distances, a row for each cell.
DISTANCES = [
    [0, 3, 4, 3, 4, 4, 3, 4, 2, 4, 5, 4, 4, 4, 4, 4, 4, 4, 5, 5],
    [3, 0, 1, 2, 5, 5, 2, 4, 2, 2, 5, 4, 3, 5, 2, 4, 5, 3, 4, 4],
    [4, 1, 0, 3, 5, 4, 3, 4, 3, 1, 4, 4, 3, 5, 2, 4, 4, 4, 5, 4],
    [3, 2, 3, 0, 4, 4, 1, 3, 3, 4, 4, 4, 2, 4, 4, 3, 4, 1, 5, 4],
    [4, 5, 5, 4, 0, 3, 4, 3, 4, 6, 5, 4, 3, 0, 6, 4, 3, 5, 4, 4],
    [4, 5, 4, 4, 3, 0, 4, 3, 4, 5, 3, 1, 3, 3, 6, 4, 3, 5, 2, 2],
    [3, 2, 3, 1, 4, 4, 0, 3, 2, 3, 4, 3, 1, 3, 3, 3, 3, 1, 4, 4],
    [4, 4, 4, 3, 3, 3, 3, 0, 2, 5, 2, 4, 3, 3, 5, 1, 2, 4, 2, 1],
    [2, 2, 3, 3, 4, 4, 2, 2, 0, 4, 3, 4, 4, 4, 3, 2, 3, 4, 3, 3],
    [4, 2, 1, 4, 6, 5, 3, 5, 4, 0, 5, 5, 4, 6, 3, 5, 4, 5, 5, 5],
    [5, 5, 4, 4, 5, 3, 4, 2, 3, 5, 0, 3, 4, 5, 6, 2, 4, 5, 2, 1],
    [4, 4, 4, 4, 4, 1, 3, 4, 4, 5, 3, 0, 3, 4, 6, 4, 4, 5, 3, 3],
    [4, 3, 3, 2, 3, 3, 1, 3, 4, 4, 4, 3, 0, 2, 3, 3, 2, 2, 3, 3],
    [4, 5, 5, 4, 0, 3, 3, 3, 4, 6, 5, 4, 2, 0, 6, 4, 3, 5, 4, 4],
    [4, 2, 2, 4, 6, 6, 3, 5, 3, 3, 6, 6, 3, 6, 0, 4, 6, 5, 6, 6],
    [4, 4, 4, 3, 4, 4, 3, 1, 2, 5, 2, 4, 3, 4, 4, 0, 3, 4, 3, 2],
    [4, 5, 4, 4, 3, 3, 3, 2, 3, 4, 4, 4, 2, 3, 6, 3, 0, 4, 2, 2],
    [4, 3, 4, 1, 5, 5, 1, 4, 4, 5, 5, 5, 2, 5, 5, 4, 4, 0, 6, 5],
    [5, 4, 5, 5, 4, 2, 4, 2, 3, 5, 2, 3, 3, 4, 6, 3, 2, 6, 0, 0],
    [5, 4, 4, 4, 4, 2, 4, 1, 3, 5, 1, 3, 3, 4, 6, 2, 2, 5, 0, 0],
]
# The known tree; parent, child, weight.
TREE = [
    (-1, 8, 1.5),
    (-1, 6, 1.5),
    (6, 30, 1),
    (6, 25, 2),
    (6, 16, 2),
    (8, 72, 4),
    (8, 22, 4),
    (8, 20, 4),
    (30, 48, 1),
    (30, 71, 2),
    (25, 43, 1),
    (72, 21, 0),
    (22, 38, 1),
    (22, 54, 2),
    (16, 65, 1),
    (20, 50, 2),
    (20, 56, 2),
    (20, 32, 1),
    (20, 57, 2),
    (20, 34, 1),
]


def known_cells():
    """(level, ord, cell, profile)."""
    return [(level, k, cell, profile) for level, own in enumerate(CELLS) for k, (cell, profile) in enumerate(own)]


def known_distances():
    return np.array(DISTANCES, float)


def test_known_distances():
    """All but one of the 190 pairs; the rule behind the other isn't known."""
    own, known = known_cells(), known_distances()
    other = [(own[i][2], own[j][2], distance.distance(own[i][3], own[j][3]), int(known[i, j])) for i in range(20) for j in range(i + 1, 20) if distance.distance(own[i][3], own[j][3]) != known[i, j]]
    assert other == [(30, 54, 4, 5)]


def test_known_tree(spark):
    own, known = known_cells(), known_distances()
    cells = spark.createDataFrame([("r", *c) for c in own], "run_id string, level int, ord int, cell_id long, genome array<int>").repartition(3)
    far = spark.createDataFrame([("r", i, j, own[i][2], float(known[i, j])) for i in range(20) for j in range(20)], "run_id string, i int, j int, id_i long, dist double").repartition(3)
    rows = linking.reconstruct(cells, far, 4).collect()
    wanted = {(child, parent, float(weight)) for parent, child, weight in TREE}
    assert len(rows) == 21 and {(r["node_id"], r["parent_id"], r["weight"]) for r in rows if r["parent_id"] is not None} == wanted
    level = {r["node_id"]: r["level"] for r in rows}
    assert [sorted(level.values()).count(k) for k in range(4)] == [12, 6, 2, 1] and level[-1] == 3 and {r["cell_id"] for r in rows if r["node_id"] == 72} == {21}


def by_all_subsets(values):
    """The largest number of disjoint groups that sum to zero, over all subsets."""
    n = len(values)
    sums, best = np.zeros(1 << n, np.int64), np.zeros(1 << n, np.int8)
    for i, v in enumerate(values):
        sums[1 << i : 2 << i] = sums[: 1 << i] + v
    masks = np.arange(1 << n)
    for size in range(1, n + 1):
        own = masks[np.bitwise_count(masks) == size]
        got = np.max([np.where(own >> i & 1, best[own & ~(1 << i)], 0) for i in range(n)], axis=0)
        best[own] = got + (sums[own] == 0)
    return int(best[-1])


def test_distance_beyond_sixteen_breakpoints():
    r = random.Random(6)
    for n, high in ((12, 9), (15, 30), (17, 9), (18, 14), (19, 40)):
        values = [r.choice([-1, 1]) * r.randint(1, high) for _ in range(n - 1)]
        values = tuple(sorted(x for x in (*values, -sum(values)) if x))
        assert distance.zero_groups(values) == (by_all_subsets(values),) * 2, values


def test_groups_of_four_are_found():
    values = tuple(sorted(x for k in (1, 10, 100, 1000, 10_000) for x in (7 * k, 5 * k, -3 * k, -9 * k)))
    assert distance.zero_groups(values) == (5, 5)


def test_a_search_that_ends_early_gives_bounds():
    r = random.Random(1)
    values = [r.randint(-10**6, 10**6) for _ in range(39)]
    values = tuple(sorted((*values, -sum(values))))
    low, high = distance.zero_groups(values, 1000)
    assert 1 <= low < high <= 13
    assert low <= distance.zero_groups(values, 5000)[1] <= high


def test_matrix_in_blocks(spark):
    own = spark.createDataFrame([(run, k, k * 7, [int(x) for x in np.random.default_rng(k).integers(0, 5, 6)]) for run, n in (("a", 11), ("b", 1), ("c", 4)) for k in range(n)], "run_id string, ord int, cell_id int, genome array<int>")
    whole = {(r["run_id"], r["i"], r["j"]): (r["id_i"], r["id_j"], r["dist"], r["exact"]) for r in distance.matrix(own).collect()}
    assert whole == {(r["run_id"], r["i"], r["j"]): (r["id_i"], r["id_j"], r["dist"], r["exact"]) for r in distance.matrix(own, block=3).collect()}
    assert len(whole) == 121 + 1 + 16 and all(x[3] for x in whole.values())


def quantile(u, mean):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if u <= total:
            return k
        k += 1


def test_poisson_quantiles_of_large_means(spark):
    cases = [(u, float(mean)) for u in (1e-6, 0.1, 0.5, 0.999) for mean in (0.3, 40, 700, 701, 746, 800, 3000)]
    rows = spark.createDataFrame(cases, "u double, mean double").select("u", "mean", poisson(F.col("u"), F.col("mean")).alias("k")).collect()
    assert [(r["u"], r["mean"], r["k"]) for r in rows] == [(u, m, quantile(u, m)) for u, m in cases]


def test_options_of_events(spark):
    loss, gain = (0, 1, "loss", -1), (0, 1, "duplication", 3)
    genome = F.array(F.lit(2), F.lit(1))
    plain = one(spark, profiles.apply_events(genome, events(loss, gain)))
    kept = one(spark, profiles.apply_events(genome, events(loss, gain), absorbing=True))
    assert plain["genome"] == [4, 3] and kept["genome"] == [4, 0]
    for everywhere in (False, True):  # the second locus is lost and crucial, the event starts on the first
        assert one(spark, profiles.apply_events(genome, events(loss), F.lit([False, True]), everywhere))["dead"] is everywhere


def test_events_end_with_their_chromosome(spark):
    from dataclasses import replace

    model = replace(MODEL, event_prob=0.5, multiple_prob=1.0, telomeres=False, crucial=False)
    rows = loci.constant_loci(spark, model).withColumn("chromosome", F.floor(F.col("pos") / 4).cast("int"))
    genome = evolve.Genome.of(loci.resolve(rows, model))
    assert genome.last == [3] * 4 + [7] * 4 + [9] * 2
    draws = lambda m: [e for r in spark.range(60).select(evolve.draw_events(m, genome, "id").alias("e")).collect() for e in r["e"]]
    assert any(e["pos_end"] // 4 > e["pos_start"] // 4 for e in draws(model))
    clipped = draws(replace(model, clip_chromosomes=True))
    assert clipped and all(e["pos_end"] // 4 == e["pos_start"] // 4 for e in clipped)


def test_locus_values_draw_where_asked(spark):
    from dataclasses import replace

    model = replace(MODEL, event_prob=1.0, telomeres=False, crucial=False, locus_overrides=True)
    rows = loci.constant_loci(spark, model).withColumn("duplication_prob", F.when(F.col("pos") < 5, 1.0).otherwise(0.0))
    genome = evolve.Genome.of(loci.resolve(rows, model))
    found = [e for r in spark.range(20).select(evolve.draw_events(model, genome, "id").alias("e")).collect() for e in r["e"]]
    assert {(e["pos_start"] < 5, e["type"]) for e in found} == {(True, "duplication"), (False, "loss")}


def test_full_representation_keeps_equal_siblings(spark):
    from dataclasses import replace

    model = replace(MODEL, generations=2, offspring="constant", offspring_parameter="2", event_prob=0.0, telomeres=False, representative=False)
    runs = spark.createDataFrame([("a", 1)], "run_id string, seed int")
    counts = evolve.simulate(runs, loci.resolve(loci.constant_loci(spark, model), model), model).groupBy("generation").count().collect()
    assert {r["generation"]: r["count"] for r in counts} == {0: 1, 1: 3, 2: 9}


def test_written_files_are_read_back(spark, tmp_path):
    own = known_cells()
    rows = spark.createDataFrame([(k, c, g) for k, (_, _, c, g) in enumerate(own)], "ord int, cell_id int, genome array<int>").repartition(4)
    write_profiles(rows, str(tmp_path / "profiles"))
    assert sorted(map(tuple, read_profiles(spark, str(tmp_path / "profiles")).collect())) == sorted(map(tuple, rows.collect()))
    assert profile_lines(rows).count() == 20
    known = known_distances()
    far = spark.createDataFrame([(i, j, own[i][2], float(known[i, j])) for i in range(20) for j in range(20)], "i int, j int, id_i int, dist double").repartition(4)
    write_matrix(far, str(tmp_path / "matrix"))
    assert spark.read.text(str(tmp_path / "matrix")).first()["value"] == "20"
    back = read_matrix(spark, str(tmp_path / "matrix")).collect()
    assert {(r["i"], r["j"], r["id_i"], r["id_j"], r["dist"]) for r in back} == {(i, j, own[i][2], own[j][2], known[i, j]) for i in range(20) for j in range(20)}
    spark.range(40).selectExpr("'1 0' AS value").repartition(3).write.text(str(tmp_path / "several"))
    with pytest.raises(ValueError):
        read_matrix(spark, str(tmp_path / "several"))


def test_trees_of_one_cell_have_no_rows(spark):
    cells = spark.createDataFrame([("r", 0, 0, 1, [2])], "run_id string, level int, ord int, cell_id long, genome array<int>")
    far = spark.createDataFrame([("r", 0, 0, 1, 0.0)], "run_id string, i int, j int, id_i long, dist double")
    assert linking.reconstruct(cells, far, 4).collect() == [] == linking.reconstruct_within(cells, 4).collect()
