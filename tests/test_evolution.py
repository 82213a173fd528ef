from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from phylospark.functions import profiles
from phylospark.functions.rng import poisson
from phylospark.operators import biopsy, evolve
from phylospark.operators.timing import Timings
from phylospark.plans.experiment import run_experiment
from phylospark.plans.reconstruction_queries import MODEL
from phylospark.sources import config, loci
from phylospark.sources.profiles import read_matrix, read_profiles, write_profiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def events(*own):
    return F.array(*(F.struct(F.lit(a).alias("pos_start"), F.lit(b).alias("pos_end"), F.lit(t).alias("type"), F.lit(n).alias("copies")) for a, b, t, n in own))


def test_changes_are_clamped_one_after_another(spark):
    loss = (0, 0, "loss", -1)
    got = one(spark, profiles.apply_events(F.array(F.lit(2)), events(loss, loss, loss, (0, 0, "duplication", 2))))
    assert got["genome"] == [2] and not got["dead"]


def test_a_crucial_loss_kills_even_if_restored(spark):
    own = events((0, 1, "loss", -1), (0, 1, "duplication", 3))
    genome = F.array(F.lit(2), F.lit(1))
    for crucial, dead in (([True, False], True), ([False, True], False)):  # the first locus of an event counts
        assert one(spark, profiles.apply_events(genome, own, F.lit(crucial)))["dead"] is dead


def test_event_texts_round_trip(spark):
    own = events((3, 3, "loss", -1), (1, 4, "duplication", 2))
    assert one(spark, profiles.render_events(own)) == "loss(pos=3, copies=-1);duplication(pos=1-4, copies=2)"
    assert [tuple(e) for e in one(spark, profiles.parse_events(profiles.render_events(own)))] == [(3, 3, "loss", -1), (1, 4, "duplication", 2)]
    assert one(spark, profiles.parse_events(F.lit(""))) == []


def test_poisson_quantiles(spark):
    assert [one(spark, poisson(F.lit(u), 1.0)) for u in (0.1, 0.5, 0.95)] == [0, 1, 3]


def test_fitness_mean_does_not_overflow(spark):
    for weight, mean in ((1000.0, 4.0), (-1000.0, 0.0), (0.0, 2.0)):
        assert one(spark, profiles.fitness_mean(F.array(F.lit(2)), F.array(F.lit(weight)), 4)) == pytest.approx(mean)


def runs(spark, n=3):
    return spark.createDataFrame([(f"r{i}", 700 + i) for i in range(n)], "run_id string, seed int")


def resolved(spark):
    return loci.resolve(loci.constant_loci(spark, MODEL), MODEL)


def test_effective_probabilities(spark):
    got = [r["p_event"] for r in resolved(spark).orderBy("pos").collect()]
    assert got == pytest.approx([0.12] + [0.02] * 8 + [0.12])


def test_simulated_trees(spark):
    rows = [r.asDict() for r in evolve.simulate(runs(spark), resolved(spark), MODEL).collect()]
    again = [r.asDict() for r in evolve.simulate(runs(spark).repartition(3), resolved(spark), MODEL).collect()]
    key = lambda r: (r["run_id"], r["node_id"])
    assert sorted(map(str, rows)) == sorted(map(str, again))  # whatever the partitions
    for run in {r["run_id"] for r in rows}:
        own = sorted((r for r in rows if r["run_id"] == run), key=key)
        assert [r["node_id"] for r in own] == list(range(len(own)))
        by_id = {r["node_id"]: r for r in own}
        for r in own[1:]:
            up = by_id[r["parent_id"]]
            assert up["generation"] == r["generation"] - 1 and min(r["genome"]) >= 0
            assert r["cell_id"] == (r["node_id"] if r["events"] else up["cell_id"])
            assert r["events"] or r["genome"] == up["genome"]
        for g in range(MODEL.generations + 1):
            genomes = [tuple(r["genome"]) for r in own if r["generation"] == g]
            assert len(genomes) == len(set(genomes)) >= 0


def test_biopsies(spark):
    nodes = evolve.simulate(runs(spark), resolved(spark), MODEL)
    sizes = {(r["run_id"], r["generation"]): r["count"] for r in nodes.groupBy("run_id", "generation").count().collect()}
    half = biopsy.sample(nodes, [2, 4], fraction=0.5).groupBy("run_id", "level").count().collect()
    for r in half:
        assert r["count"] == sizes[r["run_id"], [2, 4][r["level"]]] // 2
    assert all(r["count"] == min(3, sizes[r["run_id"], 5]) for r in biopsy.sample(nodes, [5], size=3).groupBy("run_id").count().collect())
    with pytest.raises(ValueError):
        biopsy.sample(nodes, [1])


def test_experiment(spark):
    model = replace(MODEL, event_prob=0.15, offspring="constant", offspring_parameter="1")
    timings = Timings()
    got = run_experiment(runs(spark), loci.resolve(loci.constant_loci(spark, model), model), model, [2, 4, 5], fraction=0.5, timings=timings).collect()
    assert {"simulation", "similarity"} < set(timings.durations)
    assert got and all(r["n_cells"] >= 3 and r["n_nodes"] > r["n_cells"] for r in got)
    assert all(r["similarity_layered"] is None or r["similarity_layered"] < 1 for r in got)


def test_configuration(spark, tmp_path):
    path = tmp_path / "model.json"
    path.write_text('{"NUMBER_OF_GENERATIONS": 8, "OFFSPRING_MODEL": "uniform_range",\n "OFFSPRING_PARAMETER": "1,3", "GENERAL_EVENT_PROB": 0.02, "GENERAL_DUPLICATION_PROB": 0.5, "GENERAL_DUPLICATION_MULTIPLICITY": 1, "GENERAL_LOSS_PROB": 0.5, "GENERAL_SINGLE_OR_MULTIPLE_EVENT_PROB": 0.01, "genome_length": 10, "initial_copies": 2, "MODEL_CRUCIAL_FOR_SURVIVAL": "True"}')
    m = config.read_model(spark, str(path))
    assert (m.generations, m.offspring_parameter, m.crucial, m.telomeres, m.representative) == (8, "1,3", True, False, True)
    for change in ({"OFFSPRING_MODEL": "odd"}, {"REPRESENTATION_TYPE": "half"}, {"MODEL_TELOMERIC_REGIONS": "true"}, {"GENERAL_LOSS_PROB": None}):
        values = {k: "1" for k in config.REQUIRED} | {"OFFSPRING_MODEL": "constant"} | change
        with pytest.raises(ValueError):
            config.model_of(values)


def test_locus_files(spark, tmp_path):
    path = tmp_path / "loci.csv"
    path.write_text("ChromosomeNumber,Start,End,Parameters\n1,0,9,CN=2;EVENT_PROB=0.8;TELOMERIC_INSTABILITY=0.5\n1,9,19,CN=2;EVENT_PROB=0.8;DUPLICATION_PROB=0.9;\n2,0,9,CN=2.9;CN=3.7;x\n2,0,9,\n")
    rows = loci.read_loci(spark, str(path)).orderBy("pos").collect()
    assert [(r["chromosome"], r["pos"], r["cn"], r["event_prob"], r["duplication_prob"]) for r in rows] == [(1, 0, 2, 0.8, None), (1, 1, 2, 0.8, 0.9), (2, 2, 3, None, None), (2, 3, 2, None, None)]
    loci.write_bed_like(loci.read_loci(spark, str(path)), str(tmp_path / "bed"))
    assert [r["cn"] for r in loci.read_loci(spark, str(tmp_path / "bed")).orderBy("pos").collect()] == [2, 2, 3, 2]
    loci.write_resolved(loci.resolve(loci.read_loci(spark, str(path)), MODEL), str(tmp_path / "resolved"), True)
    assert spark.read.csv(str(tmp_path / "resolved"), header=True).columns[-1] == "TELOMERIC_INSTABILITY"


def test_profile_and_matrix_files(spark, tmp_path):
    own = spark.createDataFrame([(0, 8, [1, 2]), (1, 21, [0, 3]), (2, 21, [0, 3])], "ord int, cell_id int, genome array<int>")
    write_profiles(own, str(tmp_path / "p"))
    assert sorted(map(tuple, read_profiles(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, own.collect()))
    (tmp_path / "m.txt").write_text("2\n8 0 3\n21 3.5 0\n")
    assert sorted(map(tuple, read_matrix(spark, str(tmp_path / "m.txt")).collect())) == [(0, 0, 8, 8, 0.0), (0, 1, 8, 21, 3.0), (1, 0, 21, 8, 3.5), (1, 1, 21, 21, 0.0)]
