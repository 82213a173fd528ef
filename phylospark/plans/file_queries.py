"""Queries over files: tables written in each format to the shared folder and read back by its reader."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from phylospark.functions.staging import shared_dir
from phylospark.plans.locus_queries import LOCI, genome, texts
from phylospark.plans.tree_queries import table
from phylospark.sources import config, loci, profiles


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def config_file(spark, sf_dir):
    """A configuration whose numbers are counts of nations and regions."""
    path, nation, region = folder(spark, "config"), table(spark, sf_dir, "nation").count(), table(spark, sf_dir, "region").count()
    entries = {"NUMBER_OF_GENERATIONS": nation, "OFFSPRING_MODEL": "uniform_range", "OFFSPRING_PARAMETER": f"1,{region}", "GENERAL_EVENT_PROB": 1 / nation, "GENERAL_DUPLICATION_PROB": 0.5, "GENERAL_DUPLICATION_MULTIPLICITY": region, "GENERAL_LOSS_PROB": 0.25, "GENERAL_SINGLE_OR_MULTIPLE_EVENT_PROB": 0.125, "genome_length": nation * region, "MODEL_CRUCIAL_FOR_SURVIVAL": "True"}
    spark.createDataFrame([({k: str(v) for k, v in entries.items()},)], "m map<string, string>").select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    model = asdict(config.read_model(spark, path))
    names = ["generations", "offspring", "offspring_parameter", "event_prob", "duplication_multiplicity", "genome_length", "representative", "telomeres", "crucial"]
    return spark.createDataFrame([tuple(model[n] for n in names)], "generations int, offspring string, offspring_parameter string, event_prob double, duplication_multiplicity double, genome_length int, representative boolean, telomeres boolean, crucial boolean").withColumn("event_prob", F.round("event_prob", 9))


def locus_file(spark, sf_dir):
    """Every part as a locus of a file, in the order of their keys; the brand's number is the chromosome."""
    path = folder(spark, "loci")
    rows = texts(spark, sf_dir).select(F.regexp_replace("p_brand", "[^0-9]", "").cast("int").alias("ChromosomeNumber"), F.lit(0).alias("Start"), F.lit(9).alias("End"), "Parameters", "p_partkey")
    rows.orderBy("p_partkey").drop("p_partkey").write.csv(path, header=True)
    return loci.read_loci(spark, path).select("pos", "chromosome", "cn", *(F.round(c, 9).alias(c) for c in ("event_prob", "telomeric_instability", "fitness_weight", "duplication_prob", "crucial")))


def profile_file(spark, sf_dir):
    """Every customer's profile, in the order of their keys."""
    path = folder(spark, "profiles")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("cell_id"), genome(F.col("c_custkey"), F.col("c_nationkey")).alias("genome"))
    profiles.write_profiles(rows, path)
    return profiles.read_profiles(spark, path).select("ord", F.col("cell_id").cast("long").alias("cell_id"), F.array_join(F.transform("genome", lambda c: c.cast("string")), ",").alias("genome"))


def matrix_file(spark, sf_dir):
    """Distances between all nations."""
    path, keys = folder(spark, "matrix"), table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))  # a matrix holds them all
    far = keys.select("keys", F.explode("keys").alias("i")).select("i", F.explode("keys").alias("j"))
    far = far.select("i", "j", (F.col("i") + 100).alias("id_i"), (F.abs(F.col("i") - F.col("j")) * 0.5).cast("double").alias("dist"))
    profiles.write_matrix(far, path)
    return profiles.read_matrix(spark, path).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "id_i", "id_j", "dist")


QUERIES = {
    "config_file": (config_file, """WITH n AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r)
SELECT n::INT AS generations, 'uniform_range' AS offspring, '1,' || r AS offspring_parameter, round(1.0::DOUBLE / n, 9) AS event_prob, r::DOUBLE AS duplication_multiplicity, (n * r)::INT AS genome_length, true AS representative, false AS telomeres, true AS crucial FROM n"""),
    "locus_file": (locus_file, f"""WITH {LOCI} SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS pos, regexp_replace(p_brand, '[^0-9]', '', 'g')::INT AS chromosome, cn, round(event_prob, 9) AS event_prob, telomeric_instability, round(fitness_weight, 9) AS fitness_weight, duplication_prob, crucial FROM l"""),
    "profile_file": (profile_file, "SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS ord, c_custkey AS cell_id, array_to_string(list_transform(range(0, 10), lambda k: ((c_custkey * (k + 3) + c_nationkey) % 5)::INT), ',') AS genome FROM customer"),
    "matrix_file": (matrix_file, "SELECT x.n_nationkey AS i, y.n_nationkey AS j, x.n_nationkey + 100 AS id_i, y.n_nationkey + 100 AS id_j, abs(x.n_nationkey - y.n_nationkey) * 0.5::DOUBLE AS dist FROM nation x, nation y"),
}
