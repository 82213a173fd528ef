"""From files to files, and runs that can't be scored."""

import json
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from phylospark.plans import experiment
from phylospark.plans.reconstruction_queries import MODEL
from phylospark.sources import loci
from phylospark.sources.profiles import read_matrix, read_profiles
from phylospark.sources.results import read_results


def test_a_run_from_files_to_files(spark, tmp_path):
    (tmp_path / "model.json").write_text(json.dumps({
        "NUMBER_OF_GENERATIONS": 5, "OFFSPRING_MODEL": "constant", "OFFSPRING_PARAMETER": "1", "GENERAL_EVENT_PROB": 0.1, "GENERAL_DUPLICATION_PROB": 0.5, "GENERAL_DUPLICATION_MULTIPLICITY": 1, "GENERAL_LOSS_PROB": 0.5,
        "GENERAL_SINGLE_OR_MULTIPLE_EVENT_PROB": 0.1, "MODEL_TELOMERIC_REGIONS": "True", "GENERAL_TELOMERIC_PERCENTAGE": 0.1, "GENERAL_TELOMERIC_INSTABILITY": 0.1,
    }))
    (tmp_path / "loci.csv").write_text("ChromosomeNumber,Start,End,Parameters\n" + "".join(f"1,{k},{k + 9},CN=2;EVENT_PROB=0.{k + 1}\n" for k in range(8)))
    out = str(tmp_path / "out")
    (row,) = experiment.run_files(spark, str(tmp_path / "model.json"), out, [3, 5], str(tmp_path / "loci.csv"), size=6, seed=3).collect()
    assert row["n_cells"] == 12 and row["reason"] is None and row["similarity_layered"] is not None
    own = [read_profiles(spark, f"{out}/biopsy_{k}").orderBy("ord").collect() for k in (0, 1)]
    assert [len(x) for x in own] == [6, 6] and all(len(r["genome"]) == 8 for x in own for r in x)
    matrix = read_matrix(spark, f"{out}/distances").collect()
    assert len(matrix) == 144 and [r["id_i"] for r in sorted(matrix, key=lambda r: (r["j"], r["i"]))][:12] == [r["cell_id"] for x in own for r in x]
    assert loci.read_loci(spark, f"{out}/loci").count() == 8 and "TELOMERIC_INSTABILITY" in spark.read.csv(f"{out}/parameters", header=True).columns
    kinds = {r["tree"]: r["count"] for r in spark.read.csv(f"{out}/edges", header=True).groupBy("tree").count().collect()}
    assert kinds["true"] == row["n_nodes"] - 1 and {"layered", "pooled"} < set(kinds)
    counts = {r["item"]: int(r["value"]) for r in spark.read.csv(f"{out}/summary", header=True).collect()}
    edges = spark.read.csv(f"{out}/edges", header=True).groupBy("tree").count().collect()
    assert counts == {"biopsy_0": 6, "biopsy_1": 6, "biopsies": 12} | {f"tree_{r['tree']}": r["count"] + 1 for r in edges}
    (line,) = read_results(spark, f"{out}/results").collect()
    assert (line["GenTreeSize"], line["TreeSize"], line["NumBiopsies"], line["biopsy_size"], line["Result"]) == (row["n_nodes"], 5, 2, 6.0, pytest.approx(row["similarity_layered"]))


def plain_similarity(left, right):
    """By the definition, all pairs of clusters; trees are {node: (parent, label)}, reached from their root."""
    from collections import Counter

    def clusters(tree):
        out = []
        for top in tree:
            own = Counter()
            for node in tree:
                at = node
                while at is not None and at != top:
                    at = tree[at][0]
                if at == top and tree[node][1] is not None:
                    own[tree[node][1]] += 1
            out.append(own)
        return out

    a, b = clusters(left), clusters(right)
    names = lambda own: {tuple(sorted(c.items())) for c in own}
    union = len(names(a) | names(b))
    jaccard = lambda x, y: 1 - Fraction((x & y).total(), (x | y).total()) if (x | y) else Fraction(0)
    part = lambda a, b: sum(jaccard(x, y) for x in a for y in b if y not in a) / (len(a) * union)
    return float(1 - part(a, b) - part(b, a))


def test_runs_are_scored_by_definition_and_none_is_lost(spark):
    model = replace(MODEL, event_prob=0.15, offspring="constant", offspring_parameter="1", generations=3)
    runs = spark.createDataFrame([("a/b", 701), ("c", 702)], "run_id string, seed int")
    tables = experiment.run_tables(runs, loci.resolve(loci.constant_loci(spark, model), model), model, [2, 3], fraction=0.5)
    trees = {}
    for r in tables.trees.collect():
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = (r["parent_id"], r["label"])
    got = {r["run_id"]: r for r in tables.results.collect()}
    assert set(got) == {"a/b", "c"}
    for run, r in got.items():
        for kind in experiment.KINDS:
            assert r[f"similarity_{kind}"] == pytest.approx(plain_similarity(trees[f"{run}/true"], trees[f"{run}/{kind}"]))
    rows = experiment.run_experiment(runs, loci.resolve(loci.constant_loci(spark, model), model), model, [2, 3], size=1).collect()
    assert [(r["similarity_layered"], r["reason"]) for r in rows] == [(None, experiment.FEW_CELLS)] * 2
    first = experiment.run_experiment(runs, loci.resolve(loci.constant_loci(spark, model), model), model, [0, 3], fraction=1.0).select("reason").distinct().collect()
    assert [r["reason"] for r in first] == [experiment.ONE_CELL]


def test_no_locus_is_suppressed_or_all(spark):
    """Loci whose weights and flags are all zero act as if they had none."""
    rows = loci.constant_loci(spark, MODEL)
    assert rows.select(F.sum(F.abs("fitness_weight")), F.sum("crucial")).first()[:] == (0.0, 0.0)


def test_readers_keep_the_order_over_splits_and_files(spark, tmp_path):
    """Files are read in splits of a hundred bytes; places count over all files in the order of their names."""
    from phylospark.sources.profiles import in_order

    lines = [f"line {k} of the file" + "x" * (k % 37) for k in range(300)]
    for name, part in (("b", lines[100:130]), ("a", lines[:100]), ("c", lines[130:])):
        (tmp_path / f"{name}.txt").write_text("\n".join(part) + "\n")
    profiles = [(k, 1000 - k % 7, [k % 5, 2, k]) for k in range(200)]
    (tmp_path / "profiles").mkdir()
    for name, part in (("p1", profiles[:150]), ("p2", profiles[150:])):
        (tmp_path / "profiles" / name).write_text("".join(f">{c}\n{','.join(map(str, g))}\n" for _, c, g in part))
    (tmp_path / "loci").mkdir()
    for name, part in (("l1", range(120)), ("l2", range(120, 150))):
        (tmp_path / "loci" / name).write_text("ChromosomeNumber,Start,End,Parameters\n" + "".join(f"{k % 3},0,9,CN={k}\n" for k in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        text = spark.read.text([str(tmp_path / f"{n}.txt") for n in "cab"])
        assert text.rdd.getNumPartitions() > 3
        assert [r["value"] for r in in_order(text, "n").orderBy("n").collect()] == lines
        assert sorted(map(tuple, read_profiles(spark, str(tmp_path / "profiles")).collect())) == profiles
        assert [(r["pos"], r["cn"], r["chromosome"]) for r in loci.read_loci(spark, str(tmp_path / "loci")).orderBy("pos").collect()] == [(k, k, k % 3) for k in range(150)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
